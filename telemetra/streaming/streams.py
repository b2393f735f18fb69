"""Structured Streaming forms of the block counts, labels, sessions and detectors.

Rows are first reduced to closed event-time windows (append mode, watermark).
The sequential detectors then run on those windows as keyed state, so a
micro-batch hands a key a few windows, never its raw rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from telemetra.operators.online import GATE_DDL, Cusum, gate
from telemetra.session import shared_path
from telemetra.sources.tables import latest_runs


def stream_table(spark: SparkSession, folder: str, glob: str, schema: T.StructType | str,
                 files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def drain_to(df: DataFrame, label: str) -> str:
    """Run over everything available and append to a table in the shared folder.

    Progress is kept next to the table, so a restarted run continues.
    """
    spark = df.sparkSession
    out, progress = shared_path(spark, label), shared_path(spark, f"{label}-progress")
    q = (df.writeStream.format("parquet").option("checkpointLocation", progress)
         .outputMode("append").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return out


def drain(df: DataFrame, label: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(drain_to(df, label))


def follow(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream the table another query appends to.

    The sink's commit log makes each of its batches visible as a whole, and in
    order, so the closed windows of a key never arrive out of order.
    """
    return spark.readStream.schema(schema).parquet(path)


def window_counts(df: DataFrame, delay: str, size: str, slide: str | None = None,
                  keys: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """Closed event-time windows with row and attack counts."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (df.withWatermark("ts", delay).groupBy(*keys, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_pos"),
                 F.max("label").alias("label_any"), *[c.alias(k) for k, c in (extra or {}).items()])
            .select(*keys, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "n_pos",
                    "label_any", *(extra or {})))


def sessions(df: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    """Activity sessions of a device: maximal runs of rows less than ``gap`` apart.

    Sessions are merged on the map side first, so a busy device ships few rows.
    """
    df.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (df.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n"))


def _ordered(frames: Iterator[pd.DataFrame], time: str) -> pd.DataFrame:
    """The closed windows of one key in one micro-batch, in time order."""
    return pd.concat(list(frames)).sort_values(time, ignore_index=True)


def cusum(df: DataFrame, key: str, time: str, score: str, detector: Cusum) -> DataFrame:
    """Keyed CUSUM.  State: the running sum."""
    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(frames, time)
        s = state.get[0] if state.exists else 0.0
        zs, sums, alarms = [], [], []
        for v in rows[score].to_numpy():
            z, s, a = detector.advance(float(v), s)
            zs.append(z)
            sums.append(s)
            alarms.append(int(a))
        state.update((float(s),))
        yield pd.DataFrame({key: k[0], time: rows[time], "z": zs, "cusum": sums, "alarm": alarms})

    t = df.schema[key].dataType.simpleString()
    return df.select(key, time, score).groupBy(key).applyInPandasWithState(
        update, f"{key} {t}, {time} timestamp, z double, cusum double, alarm int", "s double", "append",
        GroupStateTimeout.NoTimeout)


def gated(df: DataFrame, key: str, time: str, start: Sequence[float], detector: Cusum, alpha: float,
          min_benign: float) -> DataFrame:
    """Keyed guarded baseline.  State: [sum, *triangle], as in the batch form."""
    init = [0.0, *[float(v) for v in start]]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(frames, time)
        s = np.array(state.get[0] if state.exists else init, dtype=float)
        cols, s = gate(rows, s, detector, alpha, min_benign)
        state.update((s.tolist(),))
        yield pd.DataFrame({key: k[0], time: rows[time], **cols})

    t = df.schema[key].dataType.simpleString()
    return df.select(key, time, "r", "benign_fraction", "n").groupBy(key).applyInPandasWithState(
        update, f"{key} {t}, {time} timestamp, {GATE_DDL}", "s array<double>", "append",
        GroupStateTimeout.NoTimeout)


def latest_by_batch(df: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """Keep the last row per key of a stream of results.

    Each micro-batch is reduced first and written under its own number; a
    replayed batch overwrites the same folder, so the outcome is exact.
    """
    spark = df.sparkSession
    out, progress = shared_path(spark, label), shared_path(spark, f"{label}-progress")

    def write(batch: DataFrame, number: int) -> None:
        latest_runs(batch, keys, order).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", progress)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_runs(spark.read.schema(df.schema).parquet(f"{out}/batch=*"), keys, order)
