"""Ordered operators that never put a whole group into one task.

Position in a group, previous value and running sum are usually written as a
window over the group.  One device, block or scenario may hold a third of all
rows, and such a window would sort that third in a single task.  Here the order
is first cut into *slices* (an order-preserving integer or string).  Each slice
is numbered on its own, and the small per-slice totals supply the offsets:

    value(row) = total of earlier slices in the group + value inside the slice

The rows are shuffled once, on (group, slice).
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemetra.session import materialize

SLICE = "_slice"
NULL_SLICE = -1     # rows without an order value form a slice of their own, before all others
ROWS_PER_SLICE = 250_000
MIN_SLICES = 8
MAX_SLICES = 8192
COUNTED_CELLS = 1 << 16     # cells of an order that are counted instead of sketched


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys of the left side stay."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(operator.and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_other_{k}`")) for k in keys])
    out = left.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_other_{k}" for k in keys])


def add_slices(df: DataFrame, lead: Column, tie: Column | None = None,
               rows_per_slice: int = ROWS_PER_SLICE, name: str = SLICE) -> DataFrame:
    """Equal-depth, order-preserving slices of the order (lead, tie).

    ``lead`` is numeric; ``tie`` (an integer) splits rows that share one lead
    value, so a hot timestamp is cut as well.  The two are folded into one
    monotone double.  Boundaries come from a bounded quantile sketch and become
    literals, so every evaluation, retries included, sees the same slices.  Whole
    numbers of a small range (days) are counted in cells, which costs far less
    per row than a sketch, unless a cell holds more than a slice.  Rows whose ``lead`` or ``tie`` is null come first, as nulls do in an ascending order.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.min(F.when(F.abs(lead) < float("inf"), lead)).alias("lo"), F.max(lead).alias("hi")]
    if tie is not None:
        aggs += [F.min(tie).alias("t0"), F.max(tie).alias("t1")]
    s = df.agg(*aggs).first()
    if not s["n"]:
        return df.withColumn(name, F.lit(0))
    key = (lead - F.lit(s["lo"] or 0)).cast("double")
    if tie is not None:
        key = key + (tie - F.lit(s["t0"])).cast("double") / F.lit(float(s["t1"] - s["t0"] + 1))
    k = min(MAX_SLICES, max(MIN_SLICES, -(-s["n"] // rows_per_slice)))
    at = [i / k for i in range(1, k)]
    bounds = None
    whole = df.select(lead.alias("v")).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    if whole and s["hi"] is not None and s["hi"] - s["lo"] < COUNTED_CELLS:
        bounds = _counted_bounds(df, key, COUNTED_CELLS // (s["hi"] - s["lo"] + 1) if tie is not None else 1, at, rows_per_slice)
    if bounds is None:
        bounds = df.agg(F.percentile_approx(key, at, max(10_000, 4 * k)).alias("b")).first()["b"] or []
    cuts = sorted({b for b in bounds if isfinite(b)}) or [0.0]
    splits = [float("-inf"), *cuts, float("inf")]
    keyed = df.withColumn("_slice_key", key)
    out = Bucketizer(splits=splits, inputCol="_slice_key", outputCol=name).transform(keyed)
    return out.withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(NULL_SLICE))).drop("_slice_key")


def _counted_bounds(df: DataFrame, key: Column, steps: int, at: Sequence[float], rows_per_slice: int) -> list[float] | None:
    """Quantiles of the key from the counts of its cells, ``steps`` to a unit; None if a cell is larger than a slice."""
    cells = df.groupBy(F.floor(key * steps).alias("c")).agg(F.count(F.lit(1)).alias("n")).filter("c is not null")
    r = cells.agg(F.percentile("c", at, F.col("n")).alias("b"), F.max("n").alias("top")).first()
    return None if (r["top"] or 0) > rows_per_slice else [b / steps for b in r["b"] or []]


def range_slices(df: DataFrame, *order: str) -> DataFrame:
    """Slices of an order of any types (texts, several columns), stored so that every reader sees the same ones.

    Rows equal in all of ``order`` share a slice, so give columns that tell rows apart.
    """
    return materialize(df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()))


def _group(group: Sequence[str]) -> list:
    """Grouping for the small per-slice tables; a literal stands for 'no group'."""
    return list(group) if group else [F.lit(0)]


def exclusive_totals(df: DataFrame, group: Sequence[str], values: dict[str, Column],
                     slice_col: str = SLICE) -> DataFrame:
    """Per (group, slice): the sum of each value over the earlier slices."""
    sums = df.groupBy(*group, slice_col).agg(*[v.alias(n) for n, v in values.items()])
    before = W.partitionBy(*_group(group)).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in values]
    return sums.select(*group, slice_col, *offs)


def with_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                     values: dict[str, Column], slice_col: str = SLICE) -> DataFrame:
    """Inclusive running sums along the order, one new column per entry."""
    totals = exclusive_totals(df, group, {n: F.sum(v) for n, v in values.items()}, slice_col)
    inside = W.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = join_null_safe(df, totals, [*group, slice_col])
    for n, v in values.items():
        out = out.withColumn(n, F.sum(v).over(inside) + F.col(f"_off_{n}"))
    return out.drop(*[f"_off_{n}" for n in values])


def with_running_max(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                     cols: dict[str, str], slice_col: str = SLICE) -> DataFrame:
    """Largest value of the rows before, as ``{source column: new column}``; null where there is none."""
    tops = df.groupBy(*group, slice_col).agg(*[F.max(s).alias(f"_top_{d}") for s, d in cols.items()])
    earlier = W.partitionBy(*_group(group)).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*group, slice_col, *[F.max(f"_top_{d}").over(earlier).alias(f"_top_{d}") for d in cols.values()])
    inside = W.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = join_null_safe(df, carried, [*group, slice_col])
    for s, d in cols.items():
        out = out.withColumn(d, F.greatest(F.max(s).over(inside), F.col(f"_top_{d}")))
    return out.drop(*[f"_top_{d}" for d in cols.values()])


def with_last_known(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                    cols: dict[str, str], slice_col: str = SLICE) -> DataFrame:
    """The row's value or else the last one known before it, as ``{source column: new column}``."""
    last = df.groupBy(*group, slice_col).agg(*[
        F.max_by(F.when(F.col(s).isNotNull(), F.col(s)), F.when(F.col(s).isNotNull(), F.struct(*order))).alias(f"_last_{d}")
        for s, d in cols.items()])
    earlier = W.partitionBy(*_group(group)).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*group, slice_col, *[F.last(f"_last_{d}", ignorenulls=True).over(earlier).alias(f"_last_{d}")
                                               for d in cols.values()])
    inside = W.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = join_null_safe(df, carried, [*group, slice_col])
    for s, d in cols.items():
        out = out.withColumn(d, F.coalesce(F.last(s, ignorenulls=True).over(inside), F.col(f"_last_{d}")))
    return out.drop(*[f"_last_{d}" for d in cols.values()])


def with_position(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                  name: str = "pos", slice_col: str = SLICE, stored: bool = False) -> DataFrame:
    """0-based position in the group.  ``order`` must be total inside a group.

    ``stored`` totals have a known size: where that is small, the rows are shuffled for the order alone
    and not for the join with the totals as well.
    """
    totals = exclusive_totals(df, group, {"n": F.count(F.lit(1))}, slice_col)
    totals = materialize(totals) if stored else totals
    inside = W.partitionBy(*group, slice_col).orderBy(*order)
    return (join_null_safe(df, totals, [*group, slice_col])
              .withColumn(name, F.row_number().over(inside) - 1 + F.col("_off_n"))
              .drop("_off_n"))


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                  cols: dict[str, str], slice_col: str = SLICE) -> DataFrame:
    """Value of the previous row, as ``{source column: new column}``.

    The first row of a slice takes the last value of the slice before it.
    """
    last = df.groupBy(*group, slice_col).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    across = W.partitionBy(*_group(group)).orderBy(slice_col)
    carried = last.select(*group, slice_col, F.lag("_last").over(across).alias("_carry"))
    inside = W.partitionBy(*group, slice_col).orderBy(*order)
    out = join_null_safe(df, carried, [*group, slice_col])
    first = F.row_number().over(inside) == 1
    for src, dst in cols.items():
        out = out.withColumn(dst, F.when(first, F.col(f"_carry.{src}"))
                                   .otherwise(F.lag(src).over(inside)))
    return out.drop("_carry")
