"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it again as the next stage's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import bpe, decontaminate, langid, paragraphs
from telemetra.llm.common import fresh, keyed, table
from telemetra.llm.queries import vocabulary_path
from telemetra.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without a letter, and those that the codes leave open, go.

    If no row has a language to learn from, nothing can be rejected and all stay.
    """
    model = langid.learn_from_documents(docs)
    if not model.langs:
        return docs
    row, bad = fresh(docs, "_row"), fresh(docs, "_bad")
    rows = keyed(docs, key=row)
    got = langid.predict(rows.select(F.col(row).alias("row"), "text"), model, "row")
    gone = got.filter((F.col("lang_pred") == langid.UNKNOWN) | F.col("ambiguous")).select(F.col("row").alias(bad)).distinct()
    return rows.join(gone, F.col(row).eqNullSafe(F.col(bad)), "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts whose five-word shingles are 0.8 alike, and one of rows equal in id and text."""
    row = fresh(docs, "_row")
    return paragraphs.without_near_copies(keyed(docs, key=row), row, words=5, threshold=0.8).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document or line holds are cut out; n_chars follows."""
    row = fresh(docs, "_row")
    return paragraphs.without_repeats(keyed(docs, key=row), row).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    row = fresh(docs, "_row")
    return decontaminate.clean(keyed(docs, key=row), table(spark, sf_dir, "benchmark"), row).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to."""
    return bpe.encode_digests(docs, vocabulary_path(), with_ids=True)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("substring dedup", substring_dedup),
          ("benchmark decontamination", decontamination), ("BPE encoding and decoding", tokenize)]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
