"""Steps that make many rows of one: Spark sizes their output too low, so it is not broadcast."""

from pyspark.sql import functions as F

from telemetra.llm import paragraphs, passages, simhash
from telemetra.llm.common import split_cells
from telemetra.session import materialize
from test_dedup import docs_of
from test_near import near_copies


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_not_broadcast(spark):
    fps = spark.range(100).select(F.xxhash64("id").alias("fp"))
    found = plan(simhash.links(fps, 4))
    assert "SortMergeJoin" in found and "BroadcastHashJoin" not in found
    members = spark.createDataFrame([(c, i) for c in range(5) for i in range(c)], "cell long, id long")
    got = split_cells(members, "cell", "id")
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted((r["cell"], r["id"]) for r in got.collect()) == [(c, i) for c in range(2, 5) for i in range(c)]


def test_band_buckets_are_not_broadcast(spark, monkeypatch):
    """Each content has as many band keys as there are bands, of which the estimate counts one."""
    stored, keep = [], paragraphs.materialize
    monkeypatch.setattr(paragraphs, "materialize", lambda df, *a: stored.append((df.columns, plan(df))) or keep(df, *a))
    paragraphs.repeated_paragraphs(docs_of(spark, near_copies(3)), min_words=1, units=paragraphs.whole_text)
    found = [p for columns, p in stored if columns == ["cell", "id"]]
    assert len(found) == 1 and "SortMergeJoin" in found[0] and "BroadcastHashJoin" not in found[0]


def test_windows_of_texts_are_not_broadcast(spark):
    lists = materialize(spark.createDataFrame([(1, [0, 9], [5, 6]), (2, [3, 20], [5, 7])], "doc long, at array<long>, id array<long>"))
    every = lists.select("doc", F.explode(F.arrays_zip("at", "id")).alias("w")).select("doc", "w.*")
    assert "BroadcastHashJoin" not in plan(passages.repeated_spans(docs_of(spark, ["a", "b"]), found=every))
