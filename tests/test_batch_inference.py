"""Batch inference makes what its report needs and nothing else."""

from telemetra import plans
from telemetra.plans import pipelines as pl
from telemetra.operators import models, thresholds
from telemetra.plans import models as pm


def test_batch_inference_leaves_out_thresholds_and_drift(spark, sf, monkeypatch):
    def unused(*args, **options):
        raise AssertionError("not needed for the report")

    src = pm.source(spark, sf)
    full = pl.extension_method(src, models.small(pm.EXT, 4))
    want = {(r["label"], r["p"]) for r in full["scored"].filter("split = 'test'").select("label", "p").distinct().collect()}
    monkeypatch.setattr(pl, "attribution_drift", unused)
    monkeypatch.setattr(pl, "numbered", unused)
    monkeypatch.setattr(thresholds, "window_thresholds", unused)
    report = {r["row"]: r for r in plans.load()[0]["batch_inference"](spark, sf).collect()}
    assert report["accuracy"]["support"] == 100
    assert report["accuracy"]["threshold"] in {p for _, p in want}
