"""Sliced order operators equal their sequential meaning, hot groups and ties included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemetra.operators import ordering as o
from telemetra.operators import windows
from telemetra.operators.cleaning import exact_quantiles, group_quantiles, value_counts


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(1)
    n = 3000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n))
    t = rng.integers(0, 400, n)
    t[:900] = 77                     # a third of the rows share one timestamp
    pdf = pd.DataFrame({"g": g, "t": t, "id": rng.permutation(n), "v": rng.integers(0, 3, n)})
    return pdf, spark.createDataFrame(pdf)


def test_position_previous_and_running_sum(events):
    pdf, df = events
    s = o.add_slices(df, F.col("t"), F.col("id"), rows_per_slice=50)
    assert s.select("_slice").distinct().count() > 30
    # the shared timestamp is cut too
    assert s.filter("t = 77").select("_slice").distinct().count() > 5
    out = o.with_position(s, ["g"], ["t", "id"])
    out = o.with_previous(out, ["g"], ["t", "id"], {"v": "pv"})
    out = o.with_running_sum(out, ["g"], [F.col("t"), F.col("id")], {"cv": F.col("v")}).toPandas()
    want = pdf.sort_values(["g", "t", "id"])
    want["pos"] = want.groupby("g").cumcount()
    want["pv"] = want.groupby("g")["v"].shift()
    want["cv"] = want.groupby("g")["v"].cumsum()
    m = want.merge(out, on="id", suffixes=("", "_o"))
    assert len(m) == len(pdf) == len(out)
    assert (m["pos"] == m["pos_o"]).all() and (m["cv"] == m["cv_o"]).all()
    assert (m["pv"].fillna(-1) == m["pv_o"].fillna(-1)).all()


def test_global_position(events):
    pdf, df = events
    out = o.with_position(o.add_slices(df, F.col("t"), F.col("id"), 100), [], ["t", "id"]).toPandas()
    want = pdf.sort_values(["t", "id"])["id"].tolist()
    assert out.sort_values("pos")["id"].tolist() == want


def test_empty_input(spark):
    df = spark.createDataFrame([], "t long, id long")
    assert o.with_position(o.add_slices(df, F.col("t"), F.col("id")), [], ["t", "id"]).count() == 0


def test_sliding_windows(spark):
    pdf = pd.DataFrame({"block": [0] * 25 + [1] * 7, "pos": [*range(25), *range(7)]})
    pdf["label"] = (pdf["pos"] % 11 == 0).astype(int)
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf.index, "s")
    got = windows.sliding(spark.createDataFrame(pdf), ["block"], 8, 3).toPandas()
    want = {(0, s) for s in range(0, 25 - 8 + 1, 3)}
    assert set(zip(got["block"], got["start"])) == want
    for r in got.itertuples():
        y = pdf[(pdf["block"] == 0) & pdf["pos"].between(r.start, r.start + 7)]["label"]
        assert r.label_any == y.max() and r.label_last == y.iloc[-1]


def test_carry_values(spark):
    w = spark.createDataFrame([(0, 0, 5, 1.0), (0, 1, 5, 2.0), (0, 2, 3, 9.0), (1, 0, 2, 7.0)],
                              "block int, win int, n int, v double")
    got = {(r["block"], r["win"]): r["v"] for r in windows.carry_values(w, ["block"], 5, "v").collect()}
    assert got[0, 0] == 1.0 and got[0, 1] == 2.0 and got[0, 2] == 2.0
    assert (1, 0) not in got


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    a = np.exp(rng.normal(0, 3, 4000))          # heavy tail, all distinct
    b = np.where(rng.random(4000) < 0.4, 5.0, rng.random(4000) * 100)   # one hot value
    pdf = pd.DataFrame({"a": a, "b": b})
    pdf.loc[rng.random(4000) < 0.1, "a"] = None
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))) \
        .withColumn("c", F.lit(None).cast("double"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    for c in "ab":
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), probs), rtol=1e-12)
    assert got["c"] == [None] * len(probs)


def test_group_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(2000) < 0.5, 0, rng.integers(1, 20, 2000)),
                        "v": np.round(np.exp(rng.normal(0, 2, 2000)), 2)})
    got = group_quantiles(value_counts(spark.createDataFrame(pdf), ["g"], "v"), ["g"], "v", {"a": 0.25, "b": 0.9}).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.25, 0.9]).unstack()
    assert np.allclose(got["a"].sort_index(), want[0.25]) and np.allclose(got["b"].sort_index(), want[0.9])


def test_null_keys_and_null_order_values_stay(spark):
    rows = [(None, 3, 1), (None, 1, 2), ("a", None, 3), ("a", 2, 4), ("a", 5, 5), (None, None, 6)]
    s = o.add_slices(spark.createDataFrame(rows, "g string, t long, id long"), F.col("t"), rows_per_slice=1)
    out = o.with_position(s, ["g"], ["t", "id"])
    out = o.with_previous(out, ["g"], ["t", "id"], {"id": "before"})
    out = o.with_running_sum(out, ["g"], [F.col("t"), F.col("id")], {"sum": F.col("id")})
    got = {r["id"]: (r["pos"], r["before"], r["sum"]) for r in out.collect()}
    assert got == {6: (0, None, 6), 2: (1, 6, 8), 1: (2, 2, 9), 3: (0, None, 3), 4: (1, 3, 7), 5: (2, 4, 12)}


def test_whole_numbers_are_counted_unless_a_cell_is_larger_than_a_slice(spark, monkeypatch):
    sketched, sketch = [], F.percentile_approx
    monkeypatch.setattr(o.F, "percentile_approx", lambda *a: sketched.append(1) or sketch(*a))
    df = spark.range(4000).select((F.col("id") % 7).cast("int").alias("day"), F.col("id").alias("tie"))
    s = o.add_slices(df, F.col("day"), F.col("tie"), 200)
    assert not sketched
    depth = s.groupBy("_slice").count().toPandas()["count"]
    assert len(depth) == 20 and depth.max() <= 220
    got = o.with_position(s, [], ["day", "tie"]).toPandas().sort_values(["day", "tie"])
    assert got["pos"].tolist() == list(range(4000))
    o.add_slices(df.withColumn("tie", F.lit(1)), F.col("day"), F.col("tie"), 200)
    assert len(sketched) == 1


def test_positions_of_rows_with_stored_totals_shuffle_once(spark, sf):
    from telemetra.sources import fixtures as fx
    plan = fx.li_positions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
