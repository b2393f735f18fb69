"""Row-count windows inside blocks: fixed, complete, sliding, carried forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.operators.ordering import join_null_safe, range_slices, with_previous, with_running_sum


def window_stats(df: DataFrame, keys: Sequence[str], label: str = "label",
                 extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per window.  A window has a fixed number of rows, so groups stay small."""
    return df.groupBy(*keys, "win").agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_pos"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        *[c.alias(k) for k, c in (extra or {}).items()])


def complete(windows: DataFrame, size: int) -> DataFrame:
    return windows.filter(F.col("n") == size)


def carry_values(windows: DataFrame, keys: Sequence[str], size: int, value: str) -> DataFrame:
    """Value per window where an incomplete window takes the one before it.

    Each complete window offers its value to itself and to its successor; the
    own value wins.  No ordered pass over a block's windows is needed.
    """
    full = complete(windows, size)
    own = full.select(*keys, "win", F.lit(0).alias("_late"), value)
    nxt = full.select(*keys, (F.col("win") + 1).alias("win"), F.lit(1).alias("_late"), value)
    return (own.unionByName(nxt).groupBy(*keys, "win")
            .agg(F.min_by(value, "_late").alias(value)))


def sliding(df: DataFrame, keys: Sequence[str], size: int, stride: int, label: str = "label",
            extra: dict[str, Column] | None = None) -> DataFrame:
    """Windows starting at 0, stride, 2*stride ... that fit inside their group.

    Every row is sent to the at most ceil(size / stride) starts that contain it.
    """
    pos = F.col("pos")
    first = F.greatest(F.lit(0), F.ceil((pos - (size - 1)) / F.lit(stride)) * stride)
    last = F.floor(pos / F.lit(stride)) * stride
    step = F.lit(stride).cast("long")
    starts = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), step))
    rows = df.withColumn("start", F.explode(starts))
    return (rows.groupBy(*keys, "start")
            .agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("label_any"),
                 F.max_by(label, "pos").alias("label_last"),
                 F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
                 *[c.alias(k) for k, c in (extra or {}).items()])
            .filter(F.col("n") == size))


def tensor(features: Sequence[str]) -> Column:
    """Ordered (time, feature) matrix of one window as nested arrays."""
    steps = F.array_sort(F.collect_list(F.struct("pos", F.array(*features).alias("x"))))
    return F.transform(steps, lambda s: s["x"])


def runs(df: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Maximal runs of equal values along the order; ``df`` carries order slices."""
    prev = with_previous(df, [], [F.col(c) for c in order], {value: "_prev"})
    changed = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)), 1).otherwise(0)
    ids = with_running_sum(prev.withColumn("_new", changed), [], [F.col(c) for c in order],
                           {"run": F.col("_new")})
    return (ids.groupBy("run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"),
                                   F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")))


def with_preceding(windows: DataFrame, keys: Sequence[str], cols: dict[str, str],
                   ordinal: str = "win") -> DataFrame:
    """Columns of the window before, by an equi-join on the ordinal.

    A ``lag`` over the group would put all windows of one block in one task.
    """
    before = windows.select(*keys, (F.col(ordinal) + 1).alias(ordinal),
                            *[F.col(s).alias(d) for s, d in cols.items()])
    return join_null_safe(windows, before, [*keys, ordinal], "left")


def block_ordinals(windows: DataFrame, block: str, within: Sequence[str] = ()) -> DataFrame:
    """First window number of each block in its stream, blocks taken in order.

    One row per block, counted up over slices of the block order.
    """
    per = windows.groupBy(*within, block).agg(F.count(F.lit(1)).alias("n_win"))
    run = with_running_sum(range_slices(per, block, *within), within, [F.col(block)], {"_run": F.col("n_win")})
    return run.select(*within, block, (F.col("_run") - F.col("n_win")).alias("first_ord"))


def with_ordinal(windows: DataFrame, block: str, within: Sequence[str] = (),
                 name: str = "ord") -> DataFrame:
    """Number the windows of a stream across its blocks."""
    first = block_ordinals(windows, block, within)
    return (join_null_safe(windows, first, [*within, block])
            .withColumn(name, F.col("first_ord") + F.col("win")).drop("first_ord"))
