"""Session helpers: settings every job relies on, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on.

    All timestamps are UTC.  Adaptive execution is left to the cluster's own
    setting (it is on by default); nothing here fixes a partition count.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster an
    executor could not read what another one wrote there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-telemetra-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Store a table in the shared folder and continue from there.

    Used where a result is read several times.  A lost executor then costs a
    re-read instead of a re-computation, later reads prune columns, and the
    known file size lets the optimizer choose broadcast joins by itself.
    ``file_rows`` bounds the rows of a file (0: no bound).
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    with shuffles_removed(spark):
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as it is written.

    Otherwise they stay until the driver collects its garbage, and the disk
    holds the shuffles of many stored tables at once.
    """
    return settings(spark, {REMOVE_SHUFFLES: "true"})


def file_by_file(spark: SparkSession):
    """No partition of a scan that starts inside holds more than one file.

    A file costs as much to open as a partition may hold, so it fills one.
    """
    return settings(spark, {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.files.openCostInBytes": "4m"})


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
