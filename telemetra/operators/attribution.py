"""Feature attributions, their ranking per window, and rank drift.

All of it is column arithmetic: with f features a window carries f importances,
its ranking is f comparisons sums, and Kendall's tau is a sum over f(f-1)/2 sign
products.  No row is multiplied by the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.numeric import total
from telemetra.functions.seeded import shuffle_key


def fit_linear(df: DataFrame, features: Sequence[str], label: str = "label") -> dict[str, tuple[float, float]]:
    """(weight, mean) per feature: class mean difference over variance; constants weigh 0."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.when(F.col(label) == 1, F.col(f))).alias(f"p_{f}"),
                 F.avg(F.when(F.col(label) == 0, F.col(f))).alias(f"n_{f}"),
                 F.avg(f).alias(f"m_{f}"), F.var_pop(f).alias(f"v_{f}")]
    r = df.agg(*aggs).first()
    return {f: ((r[f"p_{f}"] - r[f"n_{f}"]) / r[f"v_{f}"] if r[f"v_{f}"] else 0.0, r[f"m_{f}"])
            for f in features}


def attributions(model: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Exact additive attributions of a linear score: w * (x - mean)."""
    return {f"a_{f}": F.lit(w) * (F.col(f) - F.lit(m)) for f, (w, m) in model.items()}


def importance(model: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Mean absolute attribution per feature, as aggregates."""
    a = attributions(model)
    return {f"imp_{f}": F.avg(F.abs(a[f"a_{f}"])) for f in model}


def window_importance(df: DataFrame, keys: Sequence[str], model: dict[str, tuple[float, float]],
                      extra: dict[str, Column] | None = None) -> DataFrame:
    cols = {**(extra or {}), **importance(model)}
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in cols.items()])


def sampled(df: DataFrame, keys: Sequence[str], n: int, seed: int, row_key: Sequence[str]) -> DataFrame:
    """The first n rows of each fixed-size window in a seeded shuffle."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(shuffle_key(seed, *[F.col(k) for k in row_key]))
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def rank_columns(features: Sequence[str], prefix: str = "imp_") -> dict[str, Column]:
    """0 = most important; ties go to the earlier feature."""
    out = {}
    for i, f in enumerate(features):
        ahead = []
        for j, g in enumerate(features):
            if i == j:
                continue
            a, b = F.col(f"{prefix}{g}"), F.col(f"{prefix}{f}")
            ahead.append(F.when((a >= b) if j < i else (a > b), 1).otherwise(0))
        out[f"rank_{f}"] = total(ahead)
    return out


def with_ranks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns(rank_columns(features))


def reference_ranks(df: DataFrame, model: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Ranking over all given rows: f numbers."""
    row = df.agg(*[c.alias(k) for k, c in importance(model).items()]).select(
        *[c.alias(k) for k, c in rank_columns(list(model)).items()]).first()
    return {f: row[f"rank_{f}"] for f in model}


def ranks_of(row, features: Sequence[str]) -> dict[str, int]:
    """Ranking by the importances in one row; ties go to the earlier feature."""
    order = sorted(features, key=lambda f: (-row[f"imp_{f}"], features.index(f)))
    return {f: order.index(f) for f in features}


def kendall(features: Sequence[str], left: dict[str, Column], right: dict[str, Column],
            nan_tau: float = 1.0) -> Column:
    """Rank correlation of two permutations; ``nan_tau`` answers for fewer than two features."""
    if len(features) < 2:
        return F.lit(nan_tau)
    terms = [F.signum((left[a] - left[b]) * (right[a] - right[b]))
             for i, a in enumerate(features) for b in features[i + 1:]]
    return total(terms) / float(len(terms))


def tau_vs_reference(df: DataFrame, features: Sequence[str], ref: dict[str, int], cut: float = 0.7,
                     nan_tau: float = 1.0) -> DataFrame:
    """Kendall's tau of each window's ranking against the reference, and the drift flag."""
    tau = kendall(features, {f: F.col(f"rank_{f}") for f in features}, {f: F.lit(ref[f]) for f in features}, nan_tau)
    return df.withColumn("tau", tau).withColumn("drift", F.when(F.col("tau") < cut, 1).otherwise(0))


def shift_flags(df: DataFrame, score: str = "shift", sigmas: float = 1.5,
                present: Column | None = None) -> DataFrame:
    """Flag scores above mean + sigmas * population deviation of the present scores."""
    v = F.when(present, F.col(score)) if present is not None else F.col(score)
    r = df.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).first()
    cut = (r["m"] or 0.0) + sigmas * (r["s"] or 0.0)
    return df.withColumn("flag", F.when(F.col(score) > F.lit(cut), 1).otherwise(0))


def drift_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_windows"), F.sum("drift").cast("long").alias("n_drift"),
                  F.round(F.avg("drift"), 6).alias("drift_rate"), F.round(F.min("tau"), 6).alias("tau_min"),
                  F.round(F.avg("tau"), 6).alias("tau_mean"), F.round(F.max("tau"), 6).alias("tau_max"),
                  F.round(F.stddev_pop("tau"), 6).alias("tau_std"))


def near(df: DataFrame, other: DataFrame, col: str = "win", radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows within ``radius`` of a row in ``other``, rows without one), by equi-joins."""
    reach = other.select(F.explode(F.sequence(F.col(col) - radius, F.col(col) + radius)).alias(col)).distinct()
    return df.join(reach, col, "left_semi"), df.join(reach, col, "left_anti")
