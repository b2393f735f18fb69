"""Scans and sinks: telemetry files, split and window stores, result tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions.numeric import quoted
from telemetra.session import materialize

# Result row layout, in column order.
RESULT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("dataset", "method", "config", "feature_set", "split_policy")]
    + [T.StructField("seed", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ("precision", "recall", "f1", "fpr", "accuracy", "weighted_f1", "roc_auc")]
    + [T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn", "tn")]
    + [T.StructField("threshold", T.DoubleType()),
       T.StructField("threshold_selected_on", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("n_train", "n_test")]
    + [T.StructField(c, T.DoubleType()) for c in ("inference_latency_ms", "model_size_kb")]
    + [T.StructField("notes", T.StringType())])
COMBINED_RUNS = "multiseed_all_runs.csv"
RUN_KEYS = ["dataset", "method", "config", "split_policy", "seed"]

# Columns of the raw device telemetry that are not doubles.
RAW_STRING_COLUMNS = ["_time", "bearer_0_apn", "bearer_1_apn", "bearer_0_ip", "bearer_0_ipv6",
                      "bearer_1_ip", "bearer_1_ipv6", "ran_plmn", "tac_plmn", "registered"]


def telemetry_schema(columns: Sequence[str]) -> T.StructType:
    """Explicit schema: nothing is inferred from a 100 TB scan."""
    return T.StructType([T.StructField(c, T.StringType() if c in RAW_STRING_COLUMNS
                                       else T.DoubleType()) for c in columns])


def coerce_time(df: DataFrame, col: str) -> DataFrame:
    """Parse text timestamps; rows that do not parse are dropped."""
    return df.withColumn(col, F.expr(f"try_cast(`{col}` as timestamp)")).na.drop(subset=[col])


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the first line with any character of every file, read by one job.

    Every file has a task of its own, which takes one small batch of lines and
    leaves the rest unread.
    """
    # no two files share a task if opening one counts as much as a task may hold
    own = {"spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
           "spark.sql.execution.arrow.maxRecordsPerBatch": "16"}
    before = {k: spark.conf.get(k) for k in own}

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column("at")[0].as_py():       # a later part of a file
                return
            for i, line in enumerate(b.column("value").to_pylist()):
                if line.strip():
                    yield b.slice(i, 1).select(["file", "value"])
                    return

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return materialize(lines.mapInArrow(work, "file string, value string")).withColumnRenamed("value", "line")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files whose columns may stand in any order; ``_file`` keeps Spark's file metadata.

    One job reads the first line of every file; files are grouped by it and each
    different header is one scan, so the number of jobs does not follow the number
    of files.  Only with several headers are file names listed on the driver.
    Other columns are left out, empty files are skipped, a missing column or an
    absent path is an error.
    """
    heads = first_lines(spark, path)
    kinds_of_file = heads.groupBy("line").agg(F.min("file").alias("file")).orderBy("file").collect()
    out = None
    for r in kinds_of_file:
        one = unquote(r["file"])
        own = path if len(kinds_of_file) == 1 else sorted(
            unquote(f["file"]) for f in heads.filter(F.col("line") == r["line"]).select("file").collect())
        header = spark.read.option("header", True).csv(one).columns
        missing = [c for c in schema.names if c not in header]
        if missing:
            raise ValueError(f"columns {missing} are missing in {one}")
        kinds = {f.name: f.dataType for f in schema.fields}
        given = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
        part = spark.read.schema(given).option("header", True).csv(own).select(
            *[F.col(quoted(c)) for c in schema.names], F.col("_metadata").alias("_file"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema).withColumn("_file", F.lit(None))
    return out


def load_telemetry(spark: SparkSession, path: str, columns: Sequence[str],
                   time_col: str = "_time") -> DataFrame:
    raw = csv_by_name(spark, path, telemetry_schema(columns))
    nan_free = raw.select(*[F.when(F.isnan(quoted(c)), None).otherwise(F.col(quoted(c))).alias(c)
                            if isinstance(raw.schema[c].dataType, T.DoubleType) else F.col(quoted(c))
                            for c in columns])
    return coerce_time(nan_free, time_col)


def load_scenarios(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Every ``<scenario>/dataset.csv`` below a root, tagged with its folder.  A root without any is an error."""
    df = csv_by_name(spark, f"{root.rstrip('/')}/*/dataset.csv", schema)
    return df.withColumn("scenario", F.regexp_extract(F.col("_file.file_path"), r"([^/]+)/dataset\.csv", 1)).drop("_file")


def union_scenarios(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of scenario tables whose columns may differ."""
    out = None
    for tag, df in parts.items():
        tagged = df.withColumn("scenario", F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def write_split_store(df: DataFrame, path: str) -> None:
    """One directory per split, so that a reader of one split skips the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str, schema: T.StructType) -> DataFrame:
    """Rows of one split; the other directories are not opened."""
    return spark.read.schema(schema).parquet(path).filter(F.col("split") == split)


def save_assignment(assignment: DataFrame, config: dict, path: str) -> None:
    """Freeze a (block, split) table together with the policy that made it."""
    assignment.write.mode("overwrite").parquet(f"{path}/assignment")
    spark = assignment.sparkSession
    spark.range(1).select(F.lit(json.dumps(config, sort_keys=True)).alias("value")) \
         .coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_assignment(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    config = json.loads(spark.read.text(f"{path}/config").first()["value"])
    return spark.read.parquet(f"{path}/assignment"), config


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows found on one side only; empty when a rebuilt table equals the stored one."""
    return a.exceptAll(b).withColumn("side", F.lit("rebuilt")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("stored")))


def as_result_rows(df: DataFrame) -> DataFrame:
    """Bring any metrics table into the result layout; what is missing is null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None))
                       .cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields])


def append_results(df: DataFrame, path: str) -> None:
    as_result_rows(df).write.mode("append").parquet(path)


def latest_runs(df: DataFrame, keys: Sequence[str] = RUN_KEYS, order: str = "load_order") -> DataFrame:
    """Keep the row loaded last for each run key.

    ``max_by`` combines on the map side, so repeated runs shrink before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def load_runs(spark: SparkSession, raw_dir: str, columns: Sequence[str],
              metrics: Sequence[str]) -> DataFrame:
    """All result CSVs of all seeds and then the combined file, if there is one, coerced and
    de-duplicated: the row of the last file wins."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = csv_by_name(spark, f"{raw_dir.rstrip('/')}/{{seed_*/*_results.csv,{COMBINED_RUNS}}}", schema)
    combined = F.col("_file.file_path").contains(f"/{COMBINED_RUNS}")
    df = (df.withColumn("source_file", F.col("_file.file_path"))
          .withColumn("_order", F.struct(combined, F.col("_file.file_path"), F.col("_file.file_block_start"),
                                         F.monotonically_increasing_id())).drop("_file"))
    df = df.withColumns({m: F.expr(f"try_cast(`{m}` as double)") for m in metrics})
    df = df.withColumn("seed", F.expr("try_cast(seed as int)"))
    return latest_runs(df, order="_order").drop("_order")


def append_job(path: str, rows: DataFrame, job: dict[str, object]) -> None:
    """Write the rows of one job, chosen by its key columns, into a shared result table.

    The table is partitioned by the key columns and a job overwrites its own
    partition only: a job that runs again leaves one copy, other jobs stay.  A
    job without rows changes nothing.  All jobs of a table need the same key columns.
    """
    for c, v in job.items():
        rows = rows.filter(F.col(c).eqNullSafe(F.lit(v)))
    (as_result_rows(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*job).parquet(path))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The result table of ``append_job`` in the result layout."""
    return spark.read.schema(RESULT_SCHEMA).parquet(path).select(*RESULT_SCHEMA.names)


def write_csv_report(df: DataFrame, path: str) -> None:
    """A flat report (drift events, confusion counts) as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace rows whose key arrives again, keep the rest."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_documents(df: DataFrame, path: str) -> None:
    """Nested result documents, one JSON object per row."""
    df.write.mode("overwrite").json(path)


def write_windows(df: DataFrame, path: str) -> None:
    """Window tensors as nested arrays, with their block and start/end columns."""
    df.write.mode("overwrite").parquet(path)


