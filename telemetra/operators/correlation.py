"""Correlation behaviour of windows and its distance from a benign baseline.

Up to about a dozen features the correlations are covariance aggregates in one
``groupBy``: partial aggregation reduces each window to a few numbers before the
shuffle.  More columns go by ``comoments``, many windows to a batch; the baseline
of a vector table is summed from per-partition moments.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.numeric import total
from telemetra.operators import comoments
from telemetra.operators.ordering import join_null_safe
from telemetra.operators.windows import with_preceding

FLAT = 1e-12  # deviation at or below which a column counts as constant


def pairs(features: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]


def pair_name(a: str, b: str) -> str:
    return f"r_{a}_{b}"


def _aggregates(features: Sequence[str]) -> list[Column]:
    out = [F.stddev_samp(f).alias(f"_s_{f}") for f in features]
    return out + [F.covar_samp(a, b).alias(f"_c_{a}_{b}") for a, b in pairs(features)]


def _ratios(features: Sequence[str]) -> list[Column]:
    """r per pair; a constant column has correlation 0 with everything."""
    out = []
    for a, b in pairs(features):
        sa, sb = F.col(f"_s_{a}"), F.col(f"_s_{b}")
        r = F.when((sa > FLAT) & (sb > FLAT), F.col(f"_c_{a}_{b}") / (sa * sb)).otherwise(0.0)
        out.append(r.alias(pair_name(a, b)))
    return out


def correlations(df: DataFrame, keys: Sequence[str], features: Sequence[str],
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """Upper triangle of the correlation matrix per key, one column per pair."""
    extra = extra or {}
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()],
                                *_aggregates(features))
    return agg.select(*keys, "n", *extra, *_ratios(features))


def baseline(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Correlations over all given (benign) rows: f(f-1)/2 numbers."""
    row = correlations(df, [], features).first()
    if row["n"] < 2:
        raise ValueError("at least two benign rows are needed for a baseline")
    return {pair_name(a, b): row[pair_name(a, b)] for a, b in pairs(features)}


def long_form(wide: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, i, j, r) rows from the pair columns."""
    entries = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(pair_name(a, b)).alias("r"))
               for a, b in pairs(features)]
    return wide.select(*keys, F.inline(F.array(*entries)))


def divergence(features: Sequence[str], base: dict[str, float]) -> Column:
    """Frobenius distance over the full symmetric matrix."""
    sq = [F.pow(F.col(pair_name(a, b)) - F.lit(base[pair_name(a, b)]), 2) for a, b in pairs(features)]
    return F.sqrt(2 * total(sq))


def window_scores(df: DataFrame, keys: Sequence[str], features: Sequence[str], base: dict[str, float],
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """Divergence per window; null for a window of one row."""
    w = correlations(df, [*keys, "win"], features, extra)
    return w.withColumn("divergence", F.when(F.col("n") >= 2, divergence(features, base)))


def row_scores(df: DataFrame, keys: Sequence[str], features: Sequence[str],
               base: dict[str, float], name: str = "graph_frob_div") -> DataFrame:
    """Every row gets its window's score.

    A one-row remainder takes the score of the window before it in the same
    block; a block of one row gets 0.
    """
    return attach_scores(df, window_scores(df, keys, features, base), keys, name)


def wide_row_scores(df: DataFrame, keys: Sequence[str], features: Sequence[str] | comoments.Derived, base: np.ndarray,
                    name: str = "graph_frob_div", size: int | None = None) -> DataFrame:
    """The same for many columns, against a baseline matrix; a window's rows with a missing value are left out of it."""
    values = features if isinstance(features, comoments.Derived) else comoments.vector(features)
    got = comoments.divergences(df, [*keys, "win"], values, base, size)
    every = join_null_safe(df.select(*keys, "win").distinct(), got, [*keys, "win"], "left")
    return attach_scores(df, every, keys, name)


def attach_scores(df: DataFrame, scored: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    w = with_preceding(scored, keys, {"divergence": "_before"})
    scores = w.select(*keys, "win", F.coalesce("divergence", "_before", F.lit(0.0)).alias(name))
    # a task's share of the windows is hashed, so the rows, many times as many, need no sort
    return join_null_safe(df, scores.hint("shuffle_hash"), [*keys, "win"])


def edges(wide: DataFrame, keys: Sequence[str], features: Sequence[str], cut: float = 0.6) -> DataFrame:
    return long_form(wide, keys, features).filter(F.abs("r") >= cut)


def density(features: Sequence[str], cut: float = 0.6) -> tuple[Column, Column]:
    """(share of pairs at or above the cut, mean absolute correlation)."""
    ab = [F.abs(pair_name(a, b)) for a, b in pairs(features)]
    hit = total([F.when(c >= cut, 1.0).otherwise(0.0) for c in ab])
    return hit / float(len(ab)), total(ab) / float(len(ab))


# --- wide vectors -------------------------------------------------------------

def matrix(x: np.ndarray) -> np.ndarray:
    """Correlation matrix with zero rows for constant columns and unit diagonal."""
    sd = x.std(axis=0, ddof=1)
    live = sd > FLAT
    z = np.where(live, (x - x.mean(axis=0)) / np.where(live, sd, 1.0), 0.0)
    c = z.T @ z / (len(x) - 1)
    c = (c + c.T) / 2.0
    np.fill_diagonal(c, 1.0)
    return c


def wide_baseline(df: DataFrame, col: str, dim: int) -> np.ndarray:
    """Correlation matrix of all rows from per-partition moments.

    Each task emits one vector of sums; the totals are an ordinary aggregate, so
    the driver receives 1 + dim + dim * dim numbers whatever the row count.
    """
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(1 + dim + dim * dim)
        for b in batches:
            if len(b):
                x = np.stack(b[col].to_numpy()).astype(float)
                acc += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"m": [acc]})

    parts = df.select(col).mapInPandas(moments, "m array<double>")
    sums = (parts.select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
            .toPandas().sort_values("k")["v"].to_numpy())
    n, s, p = sums[0], sums[1:1 + dim], sums[1 + dim:].reshape(dim, dim)
    cov = (p - np.outer(s, s) / n) / (n - 1)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    live = sd > 1e-9
    scale = np.where(live, sd, 1.0)
    c = np.where(np.outer(live, live), cov / np.outer(scale, scale), 0.0)
    np.fill_diagonal(c, 1.0)
    return c


def wide_window_scores(df: DataFrame, col: str, base: np.ndarray) -> DataFrame:
    """Divergence of each window of a vector table; a window of one row has 0."""
    got = comoments.divergences(df, ["win"], F.col(col), base)
    return got.withColumn("divergence", F.coalesce("divergence", F.lit(0.0)))
