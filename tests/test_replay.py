"""Replay with feedback, attribution ranks of trees, null keys and wide correlations against plain loops."""

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemetra.operators import comoments, models, online, replay, runstats, splits, thresholds
from telemetra.operators import correlation as co


def random_tree(rng, dim, depth=3):
    n = 2 ** (depth + 1) - 1
    inner = np.arange(n) < 2 ** depth - 1
    return {"w": np.float64(rng.uniform(0.2, 1)), "pred": rng.normal(size=n), "feature": np.where(inner, rng.integers(0, dim, n), -1),
            "left": np.where(inner, 2 * np.arange(n) + 1, -1), "right": np.where(inner, 2 * np.arange(n) + 2, -1),
            "threshold": rng.uniform(0, 1.5, n)}


def walk(t, row):
    at = 0
    while t["left"][at] >= 0:
        at = t["left"][at] if row[t["feature"][at]] <= t["threshold"][at] else t["right"][at]
    return t["w"] * t["pred"][at]


def test_interval_values():
    rng = np.random.default_rng(4)
    trees = [random_tree(rng, 4) for _ in range(5)]
    x = rng.uniform(0, 1.5, (30, 4))
    cuts = replay.split_values(trees, 3)
    got = replay.interval_values(trees, x, 3, cuts)
    for v in [-1.0, *cuts, *(cuts + 1e-9), 9.0]:
        y = x.copy()
        y[:, 3] = v
        want = [sum(walk(t, r) for t in trees) for r in y]
        assert np.allclose(got[:, np.searchsorted(cuts, v, "left")], want)


@pytest.mark.parametrize("chunk", [7, 1000])
def test_feedback_replay_equals_a_loop(spark, chunk):
    rng = np.random.default_rng(11)
    trees = [random_tree(rng, 4) for _ in range(6)]
    names, rows = ["f1", "f2", "f3", "drift"], []
    for s in ("a", None):
        for win in range(40):
            for _ in range(1 if win == 39 else 12):
                rows.append((s, win, *rng.uniform(0, 1.5, 3).tolist(), None))
    df = spark.createDataFrame(rows, "stream string, win long, f1 double, f2 double, f3 double, drift double").repartition(5)
    tau, base, det, alpha = 0.5, np.zeros(3), online.Cusum(0.9, 0.3), 0.2
    shares, cuts = replay.interval_shares(df, ["stream", "win"], trees, names, "drift", tau)
    assert all(len(r["shares"]) == len(cuts) + 1 for r in shares.collect())
    w = co.correlations(df, ["stream", "win"], names[:3])
    w = w.select("stream", "win", "n", F.array(*[co.pair_name(a, b) for a, b in co.pairs(names[:3])]).alias("r"))
    w = co.join_null_safe(w, shares, ["stream", "win"])
    got = replay.feedback_replay(w, ["stream"], "win", base.tolist(), det, cuts, alpha, 0.4, chunk).toPandas()
    trail = {(r.stream, r.win): r for r in got.itertuples()}
    assert len(trail) == 80
    pdf = pd.DataFrame(rows, columns=["stream", "win", *names])
    updates = 0
    for s in ("a", None):
        mine = pdf[pdf.stream.isna()] if s is None else pdf[pdf.stream == s]
        b, c = base.copy(), 0.0
        for win, g in mine.groupby("win"):
            x = g[names].to_numpy(float)
            r = np.corrcoef(x[:, :3].T)[np.triu_indices(3, 1)] if len(x) > 1 else None
            v = float(np.sqrt(2 * ((r - b) ** 2).sum())) if len(x) > 1 else 0.0
            x[:, 3] = v
            p = replay.boosted_probability(np.array([sum(walk(t, q) for t in trees) for q in x]))
            _, c, alarm = det.advance(v, c)
            benign = float((p < tau).mean())
            move = not alarm and benign >= 0.4 and len(x) > 1
            t = trail[(s, win)]
            assert (t.alarm, t.updated) == (int(alarm), int(move)) and abs(t.divergence - v) < 1e-9 and abs(t.benign_fraction - benign) < 1e-12
            if move:
                b, updates = (1 - alpha) * b + alpha * r, updates + 1
    assert 0 < updates < 80
    seen = replay.replayed_rows(df, got_frame(spark, got), ["stream", "win"], "drift")
    assert seen.count() == df.count() and seen.filter("drift is null").count() == 0


def got_frame(spark, got):
    rows = [(None if pd.isna(r.stream) else r.stream, int(r.win), float(r.divergence)) for r in got.itertuples()]
    return spark.createDataFrame(rows, "stream string, win long, divergence double")


def test_tree_importance_sums_to_the_margin(spark):
    rng = np.random.default_rng(2)
    n = 400
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["label"] = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    pdf["split"] = np.where(np.arange(n) % 4 == 0, "val", "train")
    pdf["win"], pdf["key"] = np.arange(n) // 50, np.arange(n)
    df = spark.createDataFrame(pdf)
    m = models.fit_trees(df, ["a", "b", "c"], models.small(models.BASE_TREES, 4), None, F.col("key"))
    rows = models.tree_attribution(m, df, ["a", "b", "c"], ["key", "win"]).toPandas()
    assert np.allclose(rows[["a_a", "a_b", "a_c"]].sum(axis=1) + rows["bias"], rows["margin"])
    p = models.score(m, df, ["a", "b", "c"]).select("key", "p").toPandas().set_index("key")["p"]
    assert np.allclose(replay.boosted_probability(rows.set_index("key")["margin"]).loc[p.index], p)
    imp = models.tree_importance(m, df, ["win"], ["a", "b", "c"]).toPandas().set_index("win")
    want = rows.assign(**{c: rows[f"a_{c}"].abs() for c in "abc"}).groupby("win")[["a", "b", "c"]].mean()
    assert np.allclose(imp.loc[want.index, ["imp_a", "imp_b", "imp_c"]], want)
    assert models.tree_importance(m, df, [], ["a", "b", "c"]).count() == 1


@pytest.mark.parametrize("dim", [3, 38, 145])
def test_wide_correlations(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(None if w % 3 == 0 else f"s{w % 3}", w, (rng.normal(size=dim) * 3 + 1e4).tolist()) for w in range(12) for _ in range(25)]
    rows += [("one", 99, [1.0] * dim), ("s1", 1, [None] * dim), ("s1", 1, None)]
    for _, _, v in rows[:300]:
        v[1] = 5.0
    df = spark.createDataFrame(rows, "stream string, win long, v array<double>").repartition(7)
    got = {(r["stream"], r["win"]): r for r in comoments.correlations(df, ["stream", "win"], F.col("v"), dim).collect()}
    assert len(got) == 13 and got[("one", 99)]["n"] == 1 and set(got[("one", 99)]["r"]) == {0.0}
    for w in range(12):
        x = np.array([v for _, k, v in rows[:300] if k == w])
        with np.errstate(invalid="ignore", divide="ignore"):
            want = np.nan_to_num(np.corrcoef(x.T))[np.triu_indices(dim, 1)]
        r = got[(None if w % 3 == 0 else f"s{w % 3}", w)]
        assert r["n"] == 25 and np.allclose(r["r"], want, atol=1e-8)
    base = comoments.baseline(df, F.col("v"), dim)
    assert base.shape == (dim, dim) and np.allclose(base, base.T) and np.allclose(np.diag(base), 1)
    assert comoments.baseline(df.limit(0), F.col("v"), dim) is None
    plan = comoments.correlations(df, ["win"], F.col("v"), dim)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_null_keys_in_folds_and_window_scores(spark):
    rng = np.random.default_rng(6)
    r = rng.uniform(-1, 1, (200, 3)).tolist()
    df = spark.createDataFrame([(s, i, r[i]) for s in ("a", None) for i in range(200)], "stream string, ord long, r array<double>")
    got = online.ewma_trail(df, ["stream"], "ord", "r", 0.1, chunk=50).toPandas()
    a, b = (got[m].sort_values("ord")["divergence"].to_numpy() for m in (got.stream == "a", got.stream.isna()))
    assert len(a) == len(b) == 200 and np.allclose(a, b)

    x = rng.normal(size=(40, 2))
    rows = [("k" if i < 20 else None, (i % 20) // 10, float(u), float(v)) for i, (u, v) in enumerate(x)]
    d = spark.createDataFrame(rows, "block string, win long, f1 double, f2 double")
    out = co.row_scores(d, ["block"], ["f1", "f2"], {"r_f1_f2": 0.0}).toPandas()
    assert len(out) == 40 and out["graph_frob_div"].notna().all()
    wide = co.wide_row_scores(d, ["block"], ["f1", "f2"], np.eye(2)).toPandas()
    key = ["f1", "f2"]
    assert np.allclose(wide.sort_values(key)["graph_frob_div"], out.sort_values(key)["graph_frob_div"])

    side = spark.createDataFrame([("k", "train"), (None, "test")], "block string, split string")
    assert splits.attach(d, side, ["block"]).groupBy("split").count().count() == 2
    s = d.select("block", "win", F.lit(1).alias("y"), F.lit(0.5).alias("p"))
    w, _ = thresholds.window_thresholds(s, ["block", "win"], 10)
    assert w.count() == 4
    runs = spark.createDataFrame([(None, "x", "f1", k, m, 0.5 + k / 100 + (m == "t") / 10) for k in range(6) for m in ("t", "b")],
                                 "dataset string, split_policy string, metric string, seed int, method string, value double")
    pairs = runstats.paired(runs, "t", ["b"])
    assert pairs.count() == 6 and runstats.signed_rank(pairs, ["dataset", "metric"]).first()["w_plus"] == 21.0


def test_windows_of_full_size_are_finished_in_their_task(spark):
    """With the window's size known, moments are shuffled only of windows that are cut or short; equal results."""
    from telemetra.plans import graph
    rng = np.random.default_rng(5)
    rows = [(w // 7, w, *map(int, rng.integers(1, 900, 4))) for w in range(40) for _ in range(12 if w % 9 else 5)]
    df = spark.createDataFrame(rows, "block long, win long, o long, l long, p long, s long").repartition(3, "block")
    values = comoments.Derived(["o", "l", "p", "s"], graph.wide_values)
    dim = len(graph._WIDE)
    base = comoments.baseline(df, values, dim)
    plain = comoments.vector(graph._WIDE)
    names = dict(zip(("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ("o", "l", "p", "s")))
    cols = df.withColumnsRenamed({b: a for a, b in names.items()})
    cols = cols.select("*", *[F.expr(e).cast("double").alias(k) for k, e in graph._WIDE.items()])
    assert np.allclose(base, comoments.baseline(cols, plain, dim))
    want = {r["win"]: r["divergence"] for r in comoments.divergences(cols, ["block", "win"], plain, base).collect()}
    got = {r["win"]: r["divergence"] for r in comoments.divergences(df, ["block", "win"], values, base, 12).collect()}
    x = np.array([r[2:] for r in rows]).T
    for w in range(40):
        m = graph.wide_values(*x[:, [r[1] == w for r in rows]])
        live = m.std(axis=0) > 0
        c = np.where(np.outer(live, live), np.corrcoef(m.T + 0.0), 0.0) if live.all() else None
        if c is not None:
            assert abs(np.linalg.norm(c - base) - got[w]) < 1e-9
    assert len(want) == 40 and all(abs(want[w] - got[w]) < 1e-9 for w in want)
    parts = comoments.partial_moments(df, ["block", "win"], values, dim, 12, "divergence double",
                                      lambda n, dev: {"divergence": pa.array(np.zeros(len(dev)))}).collect()
    assert {r["win"] for r in parts if r["mean"] is None} == {w for w in range(40) if w % 9}
    assert all(r["n"] == 5 for r in parts if r["mean"] is not None)
