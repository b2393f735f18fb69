"""Missing values, exact quantiles, scaling and variance filters.

Statistics are fitted by distributed aggregates that return one row (a handful
of numbers per column) and are then folded into row expressions as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.numeric import quoted, ratio
from telemetra.operators.ordering import add_slices, join_null_safe, with_running_sum
from telemetra.operators.quantiles import exact_quantiles
from telemetra.session import materialize


def missing_percent(df: DataFrame, cols: Sequence[str], top: int | None = 10) -> DataFrame:
    """Share of nulls per column in percent, highest first."""
    n = F.count(F.lit(1))
    one = df.agg(*[(ratio(n - F.count(quoted(c)), n) * 100).alias(c) for c in cols])
    args = ", ".join(f"'{c}', {quoted(c)}" for c in cols)
    out = one.select(F.expr(f"stack({len(cols)}, {args}) as (column_name, missing_pct)"))
    out = out.orderBy(F.desc("missing_pct"), "column_name")
    return out.limit(top) if top else out


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows per (group, value), combined on the map side and stored once."""
    return materialize(df.filter(F.col(value).isNotNull()).groupBy(*group, value)
                       .agg(F.count(F.lit(1)).alias("_c")))


def group_quantiles(counted: DataFrame, group: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group from ``value_counts``, hot groups included.

    The counts accumulate over value slices, and each wanted rank is then a
    filtered minimum: no group is ever held in memory.
    """
    cum = with_running_sum(add_slices(counted, F.col(value)), group, [F.col(value)],
                           {"_cum": F.col("_c")})
    sizes = counted.groupBy(*group).agg(F.sum("_c").alias("n"))
    ranked = join_null_safe(cum, sizes, list(group))
    aggs = []
    for name, p in probs.items():
        r = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(r)), ("hi", F.ceil(r))):
            aggs.append(F.min(F.when(F.col("_cum") > rank, F.col(value))).alias(f"_{name}_{side}"))
    out = ranked.groupBy(*group, "n").agg(*aggs)
    cols = []
    for name, p in probs.items():
        r = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (r - F.floor(r))).alias(name))
    return out.select(*group, "n", *cols)


def medians(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5], where).items()}


def impute(df: DataFrame, values: dict[str, float | None], empty: float | None = None) -> DataFrame:
    """Fill nulls with fitted values; ``empty`` stands in for a column with none."""
    fills = {c: (empty if v is None else v) for c, v in values.items()}
    return df.select(*[F.coalesce(F.col(quoted(c)), F.lit(fills[c])).alias(c)
                       if fills.get(c) is not None else F.col(quoted(c)) for c in df.columns])


def fit_moments(df: DataFrame, cols: Sequence[str],
                where: Column | None = None) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column scales by 1."""
    def val(c: str) -> Column:
        return F.when(where, F.col(quoted(c))) if where is not None else F.col(quoted(c))
    row = df.agg(*[f(val(c)).alias(f"{k}{i}") for i, c in enumerate(cols)
                   for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def scale(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(quoted(c)) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in moments.items()})


def deviations(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> dict[str, dict]:
    """Sample deviation and population variance per column, for variance filters."""
    def val(c: str) -> Column:
        return F.when(where, F.col(quoted(c))) if where is not None else F.col(quoted(c))
    row = df.agg(*[f(val(c)).alias(f"{k}{i}") for i, c in enumerate(cols)
                   for k, f in (("s", F.stddev_samp), ("v", F.var_pop))]).first()
    return {c: {"std": row[f"s{i}"], "var": row[f"v{i}"]} for i, c in enumerate(cols)}


def zero_variance(df: DataFrame, cols: Sequence[str], tol: float = 0.0) -> list[str]:
    return [c for c, d in deviations(df, cols).items() if d["std"] is not None and d["std"] <= tol]


def varying(df: DataFrame, cols: Sequence[str], where: Column, tol: float = 1e-12) -> list[str]:
    return [c for c, d in deviations(df, cols, where).items() if (d["var"] or 0.0) > tol]
