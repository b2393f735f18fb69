"""Interval labelling (a range join) and label parsing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.operators.ordering import range_slices, with_position, with_running_max, with_running_sum

Interval = tuple[str, str, str]  # (name, start, end), both ends inclusive, UTC

#: A dictionary table is broadcast only up to this many rows.
BROADCAST_ROWS = 100_000


def inside(ts: Column, interval: Interval) -> Column:
    _, start, end = interval
    return ts.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def interval_flag(ts: Column, intervals: Sequence[Interval]) -> Column:
    """1 when ``ts`` lies in any of a short list of intervals; no join at all."""
    hits = [inside(ts, i) for i in intervals]
    return F.when(reduce(lambda a, b: a | b, hits), 1).otherwise(0)


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Unite overlapping intervals so that each row can match at most one.

    The furthest end before an interval is a running maximum over slices, and
    the number of its island a running sum, so no task holds the whole table.
    """
    order = [F.col("start_ts"), F.col("end_ts")]
    cut = range_slices(intervals.select("start_ts", "end_ts").distinct(), "start_ts", "end_ts")
    seen = with_running_max(cut, [], order, {"end_ts": "_reach"})
    new = seen.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start_ts") > F.col("_reach")), 1).otherwise(0))
    return (with_running_sum(new, [], order, {"_island": F.col("_new")}).groupBy("_island")
            .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
            .drop("_island"))


def label_by_intervals(df: DataFrame, ts: str, intervals: DataFrame,
                       bucket_seconds: int = 86_400, out: str = "label") -> DataFrame:
    """Label rows by membership in a *table* of intervals.

    Intervals are merged, cut at bucket borders and joined on the bucket: an
    equi-join with a residual range check.  A row meets the few pieces of its
    own bucket only, and merged intervals cannot match it twice, so no
    de-duplication of rows is needed.  The merged pieces are broadcast when
    their count is small, and joined by shuffle otherwise.
    """
    span = F.lit(bucket_seconds)
    b = F.floor(F.unix_seconds(ts) / span)
    pieces = (merge_intervals(intervals)
              .withColumn("_b", F.explode(F.sequence(
                  F.floor(F.unix_seconds("start_ts") / span),
                  F.floor(F.unix_seconds("end_ts") / span))))
              .select("_b", "start_ts", "end_ts"))
    if pieces.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pieces = F.broadcast(pieces)
    rows = df.withColumn("_b", b)
    hit = (F.col(ts) >= F.col("start_ts")) & (F.col(ts) <= F.col("end_ts"))
    return (rows.join(pieces, (rows["_b"] == pieces["_b"]) & hit, "left")
            .withColumn(out, F.when(F.col("start_ts").isNotNull(), 1).otherwise(0))
            .drop("_b", "start_ts", "end_ts"))


def interval_matches(df: DataFrame, ts: Column, intervals: Sequence[Interval]) -> DataFrame:
    """Rows matched by each interval; a row may count for several of them."""
    counts = df.agg(*[F.count(F.when(inside(ts, i), 1)).alias(i[0]) for i in intervals])
    pairs = ", ".join(f"'{i[0]}', `{i[0]}`" for i in intervals)
    return counts.select(F.expr(f"stack({len(intervals)}, {pairs}) as (name, matched)"))


def bool_label(col: Column) -> Column:
    """Text or boolean 'True' in any case gives 1, all else 0."""
    return F.when(F.lower(col.cast("string")) == "true", 1).otherwise(0)


def code_map(values: DataFrame, col: str, default: str = "normal") -> DataFrame:
    """Sorted distinct values -> 0-based codes; null takes the default value."""
    known = values.select(F.coalesce(F.col(col), F.lit(default)).alias(col)).distinct()
    return with_position(range_slices(known, col), [], [F.col(col)], "code").select(col, "code")


def extend_code_map(codes: DataFrame, values: DataFrame, col: str,
                    default: str = "normal") -> DataFrame:
    """Values unseen at fit time get fresh codes after the known ones."""
    new = (values.select(F.coalesce(F.col(col), F.lit(default)).alias(col)).distinct()
           .join(codes, col, "left_anti"))
    first = codes.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    fresh = with_position(range_slices(new, col), [], [F.col(col)], "code")
    return codes.unionByName(fresh.select(col, (F.col("code") + F.lit(first)).alias("code")))
