"""Queries of the published methods fit the published trees; boosting stops by patience."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.operators import models
from telemetra.plans import models as mq
from telemetra.plans import pipelines as pl


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, want", [
    ("ablation_runs", models.EXTENSION_TREES),
    ("attribution_drift", models.EXTENSION_TREES),
    ("extension_pipeline", models.EXTENSION_TREES),
    ("gbt_scores", models.BASE_TREES),
    ("proposed_pipeline", models.EXTENSION_TREES),
    ("ratio_tuning", models.BASE_TREES),
])
def test_queries_fit_the_published_trees(spark, sf, monkeypatch, name, want):
    def seen(df, features, config, *_):
        raise Seen(config)

    monkeypatch.setattr(models, "fit_trees", seen)
    with pytest.raises(Seen) as got:
        getattr(mq, name)(spark, sf)
    assert got.value.args[0] == want
    assert (want.depth, want.trees, want.step) in ((6, 2000, 0.1), (6, 1000, 0.05))


def test_best_round_waits_for_the_patience():
    assert models.best_round([5, 4, 4.5, 3, 3.5, 3.2, 2], 2) == (3, True)      # the last round is never made
    assert models.best_round([5, 4, 4.5, 3, 3.5, 3.2, 2], 3) == (6, False)
    assert models.best_round([1.0], 50) == (0, False)


def test_boosting_goes_on_through_rounds_that_gain_little(spark):
    """A run of more rounds begins with those of a shorter one, and the model ends at the lowest validation loss."""
    rows = spark.range(600).select(F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"), F.col("id").alias("key"),
                                   (F.xxhash64("id") % 100).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 100).cast("double").alias("b"))
    rows = rows.withColumn("label", (F.col("a") * F.col("a") + 40 * F.col("b") > 3000).cast("int")).localCheckpoint()
    config = replace(models.BASE_TREES, depth=2, trees=14, patience=3)
    fit = lambda c: models.fit_trees(rows, ["a", "b"], c, None, F.col("key"))
    long = fit(replace(config, patience=14))
    m = fit(config)                                    # runs of 9 and 14 rounds
    assert m.getNumTrees > 3
    assert [t.toDebugString.split("\n", 1)[1] for t in m.trees] == [t.toDebugString.split("\n", 1)[1] for t in long.trees[:m.getNumTrees]]
    val = models.assemble(rows.filter("split = 'val'"), ["a", "b"]).withColumn("weight", F.lit(1.0))
    losses = long.evaluateEachIteration(val)
    assert m.getNumTrees == models.best_round(losses, 3)[0] + 1
    cut = models.first_trees(long, 2)
    assert cut.getNumTrees == 2 and np.allclose(cut.evaluateEachIteration(val), losses[:2])
    p = models.score(cut, rows, ["a", "b"]).select("p").toPandas()["p"]
    assert p.between(0, 1).all() and cut.numFeatures == 2 and cut.numClasses == 2


def test_ratio_tuning_tries_all_published_ratios(spark, sf, monkeypatch):
    """Each trial tells the rows it trained on and the trees it kept, as the published table does."""
    tune = pl.tune_ratio
    monkeypatch.setattr(pl, "tune_ratio", lambda src, config, ratios: tune(src, models.small(config, 2, 2), ratios))
    got = mq.ratio_tuning(spark, sf).orderBy("ratio").toPandas()
    assert got["ratio"].tolist() == [1.0, 2.0, 5.0, 10.0] and got["chosen"].sum() == 1
    assert got["n_benign"].tolist() == [414, 828, 2070, 3882] and set(got["n_attack"]) == {414}
    assert got["n_trees"].between(1, 2).all()
    assert got.loc[got["chosen"], "val_f1"].item() == got["val_f1"].max()
