"""Model stages on a planted signal."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from telemetra.operators import metrics, models
from telemetra.plans import models as mq
from telemetra.plans import pipelines as pl


@pytest.fixture(scope="module")
def fitted(spark, sf):
    src = mq.source(spark, sf)
    return src, models.fit_trees(src.rows, src.features, models.small(models.BASE_TREES, 3), 2.0, src.key)


def test_scores_and_attributions(fitted):
    src, m = fitted
    s = models.score(m, src.rows, src.features)
    lo, hi = s.agg(F.min("p"), F.max("p")).first()
    assert 0 <= lo <= hi <= 1
    auc = metrics.roc_auc(s.select(F.col("label").alias("y"), "p")).first()["roc_auc"]
    assert auc > 0.7
    t = src.rows.filter("split = 'test'")
    a = models.tree_attribution(m, t, src.features, [*mq.ROW, "pos"]).toPandas()
    total = a[[f"a_{f}" for f in src.features]].sum(axis=1) + a["bias"]
    assert np.allclose(total, a["margin"])
    raw = m.transform(models.assemble(t, src.features)).select(vector_to_array("rawPrediction")[1].alias("m"))
    assert np.allclose(np.sort(raw.toPandas()["m"]), np.sort(a["margin"]), atol=1e-9)


def test_student_is_clipped(fitted):
    src, m = fitted
    s = models.score(m, src.rows, src.features).withColumn("target", models.soft_target(F.col("p"), F.col("label")))
    st = models.fit_student(s.filter("split = 'train'"), src.features, "target")
    lo, hi = models.student_score(st, s, src.features).agg(F.min("student_p"), F.max("student_p")).first()
    assert 0 <= lo <= hi <= 1


def test_proposed_method(spark, sf):
    src = mq.source(spark, sf)
    r = pl.proposed_method(src, models.small(models.EXTENSION_TREES, 3), pl.ABLATIONS["P6"])
    assert 0 < r["threshold"] < 1 and r["events"] is not None and r["updates"] is not None
    row = pl.result(r["scored"], r["threshold"]).first()
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == src.rows.filter("split = 'test'").count()


def test_ablations_share_their_stages(spark, sf, monkeypatch):
    """Two fits of trees (with and without the divergence) and one student serve all rows of the ladder."""
    fits, students = [], []
    trees, student = models.fit_trees, models.fit_student
    monkeypatch.setattr(models, "fit_trees", lambda *a, **k: fits.append(1) or trees(*a, **k))
    monkeypatch.setattr(models, "fit_student", lambda *a, **k: students.append(1) or student(*a, **k))
    rows = {r["config"]: r for r in mq.ablation_runs(spark, sf).collect()}
    assert list(rows) == ["P0", "P1", "P2", "P3", "P4", "P6", "P7"]
    assert len(fits) == 2 and len(students) == 1
    assert rows["P1"]["f1"] == rows["P2"]["f1"] and rows["P3"]["f1"] == rows["P6"]["f1"]
    assert rows["P1"]["drift_events"] is None and rows["P2"]["drift_events"] is not None
    assert rows["P3"]["drift_windows"] is None and rows["P4"]["drift_windows"] == rows["P7"]["drift_windows"] is not None
    assert rows["P4"]["label_loss"] is None and rows["P6"]["label_loss"] == rows["P7"]["label_loss"] is not None


def test_a_fit_reads_partitions_of_bounded_size(spark):
    wide = spark.range(0, 1_300_000, 1, 1)
    n = models.dealt(wide, 1_300_000).rdd.getNumPartitions()
    assert n == max(spark.sparkContext.defaultParallelism, 6)
    assert models.dealt(wide, 40 * models.FIT_ROWS + 1).rdd.getNumPartitions() == 41


def test_small_models_as_columns_give_what_spark_ml_gives(fitted, monkeypatch):
    src, m = fitted
    rows = models.score(m, src.rows, src.features).withColumn("target", models.soft_target(F.col("p"), F.col("label")))
    st = models.fit_student(rows.filter("split = 'train'"), src.features, "target")
    both = models.student_score(st, rows, src.features)
    keys = [*pl.KEYS, "win"]
    importance = models.tree_importance(m, src.rows, keys, src.features).toPandas()
    assert models.compact(m) and models.compact(st)
    monkeypatch.setattr(models, "COMPACT_NODES", 0)
    ml = models.student_score(st, models.score(m, both, src.features, "ml_p"), src.features, "ml_student")
    gap = ml.agg(F.max(F.abs(F.col("p") - F.col("ml_p"))), F.max(F.abs(F.col("student_p") - F.col("ml_student")))).first()
    assert max(gap) < 1e-12
    j = importance.merge(models.tree_importance(m, src.rows, keys, src.features).toPandas(), on=keys)
    assert len(j) == len(importance) and all(np.allclose(j[f"imp_{f}_x"], j[f"imp_{f}_y"]) for f in src.features)


def test_a_missing_feature_is_an_error_for_columns_too(fitted):
    src, m = fitted
    row = src.rows.limit(1).withColumn("f1", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="null or NaN"):
        models.score(m, row, src.features).select("p").collect()


def test_a_fit_reads_stored_files_and_moves_no_row(spark, sf, monkeypatch):
    monkeypatch.setattr(models, "FIT_ROWS", 200)
    src = mq.source(spark, sf, ())
    with models.fit_table(src.rows, src.rows.count()) as df:
        sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 200 and sum(sizes) == src.rows.count()
    monkeypatch.setattr(models, "dealt", lambda *a: pytest.fail("rows are dealt"))
    m = models.fit_trees(src.rows, src.features, models.small(models.BASE_TREES, 3), None, src.key)
    assert m.getNumTrees >= 1


@pytest.mark.parametrize("run", [
    lambda src: pl.proposed_method(src, models.small(models.EXTENSION_TREES, 3), pl.ABLATIONS["P6"]),
    lambda src: pl.extension_method(src, models.small(models.EXTENSION_TREES, 3))], ids=["proposed", "extension"])
def test_scores_of_all_rows_are_not_stored(spark, sf, monkeypatch, run):
    src, stored, keep = mq.source(spark, sf, ()), [], pl.materialize
    monkeypatch.setattr(pl, "materialize", lambda df, *a: stored.append(df.columns) or keep(df, *a))
    run(src)
    assert not [c for c in stored if "p" in c and "split" in c]


@pytest.mark.parametrize("run", [mq.proposed_pipeline, mq.extension_pipeline])
def test_queries_on_windows_store_no_row_keys(spark, sf, monkeypatch, run):
    class Seen(Exception):
        pass

    def seen(src, *_):
        raise Seen(src.rows.columns)

    monkeypatch.setattr(pl, "proposed_method", seen)
    monkeypatch.setattr(pl, "extension_method", seen)
    with pytest.raises(Seen) as got:
        run(spark, sf)
    assert set(got.value.args[0]) == {*pl.KEYS, "win", "split", "label", *mq.FEATS}
