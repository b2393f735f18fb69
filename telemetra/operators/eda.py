"""Exploratory aggregates: histograms, box plots, activity over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.functions.numeric import ratio
from telemetra.operators.cleaning import group_quantiles, value_counts
from telemetra.operators.ordering import add_slices, join_null_safe, with_position
from telemetra.operators.quantiles import exact_quantiles
from telemetra.session import materialize


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per class; the class table has a handful of rows."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total")).first()["total"]
    return n.withColumn("pct", ratio(F.col("n"), F.lit(total)) * 100)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum per column."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    row = df.agg(*[f(c).alias(f"{c}_{k}") for c in cols for k, f in
                   (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_mean").alias("mean"),
                      F.col(f"{c}_std").alias("std"), F.col(f"{c}_min").alias("min"),
                      *[F.lit(v).alias(k) for k, v in zip(("q25", "q50", "q75"), q[c])],
                      F.col(f"{c}_max").alias("max")) for c in cols]
    return row.select(F.inline(F.array(*parts)))


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between the extremes; the maximum falls in the last bin."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def boxplot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and 1.5 IQR outliers per group.  Quartiles are exact for hot groups too."""
    counted = value_counts(df, [group], value)
    q = group_quantiles(counted, [group], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    q = q.withColumn("_iqr", F.col("q75") - F.col("q25"))
    out = (F.col(value) < F.col("q25") - 1.5 * F.col("_iqr")) | (F.col(value) > F.col("q75") + 1.5 * F.col("_iqr"))
    return join_null_safe(counted, q, [group]).groupBy(group, "n", "q25", "q50", "q75").agg(
        F.sum(F.when(out, F.col("_c")).otherwise(0)).alias("n_outliers"))


def entity_codes(df: DataFrame, entity: str) -> DataFrame:
    """Sorted distinct ids -> 0-based codes."""
    ids = materialize(df.select(entity).distinct())
    return with_position(add_slices(ids, F.col(entity)), [], [F.col(entity)], "code").drop("_slice")
