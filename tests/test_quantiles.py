"""Rank brackets, prefix scans and dense codes equal their plain meaning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemetra.operators import labels, quantiles, windows
from telemetra.operators import ordering as o

PROBS = [0.0, 0.01, 0.25, 0.5, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 60_000
    pdf = pd.DataFrame({"tail": np.exp(rng.normal(0, 3, n)), "sorted": np.arange(n, dtype=float),
                        "hot": np.where(rng.random(n) < 0.6, 5.0, rng.random(n)), "few": rng.integers(0, 3, n).astype(float),
                        "rare": np.where(np.arange(n) % 9_000 == 0, np.arange(n) * 1.0, np.nan),
                        "one": np.where(np.arange(n) == 7, 3.5, np.nan), "none": np.full(n, np.nan)})
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def check(got, pdf):
    for c in pdf.columns:
        known = pdf[c].dropna()
        if known.empty:
            assert got[c] == [None] * len(PROBS)
        else:
            assert np.allclose(got[c], np.quantile(known, PROBS), rtol=1e-12, atol=0), c


def test_quantiles_by_brackets(table):
    pdf, df = table
    check(quantiles.exact_quantiles(df, list(pdf.columns), PROBS), pdf)
    check(quantiles.exact_quantiles(df, ["tail", "few"], PROBS, F.col("sorted") < 1234), pdf[pdf["sorted"] < 1234][["tail", "few"]])


def test_infinite_values_and_no_rows(spark):
    df = spark.createDataFrame([(float("-inf"), 1), (float("inf"), 2), (1.0, None)], "a double, b int")
    assert quantiles.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [1.0], "b": [1.5]}
    assert quantiles.exact_quantiles(df.filter("false"), ["a"], [0.1, 0.5]) == {"a": [None, None]}


def test_a_wrong_sketch_does_not_change_the_result(table, monkeypatch):
    """Grids that lie far from the data: the counts show it and the brackets are widened."""
    pdf, df = table
    honest = quantiles.sketch

    def shifted(rows, cols):
        return [{k: [x + 1000.0 for x in v] if isinstance(v, list) else v for k, v in r.asDict().items()} for r in honest(rows, cols)]
    monkeypatch.setattr(quantiles, "sketch", shifted)
    check(quantiles.exact_quantiles(df, ["tail", "sorted", "hot"], PROBS), pdf[["tail", "sorted", "hot"]])


def test_few_values_are_shuffled(table, monkeypatch):
    _, df = table
    stored = []
    keep = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda x: stored.append(keep(x)) or stored[-1])
    quantiles.exact_quantiles(df, ["tail", "sorted"], [0.5])
    assert stored[0].count() < 0.01 * 2 * df.count()


def test_running_max_and_last_known(spark):
    rng = np.random.default_rng(12)
    n = 2000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n)), "t": rng.permutation(n),
                        "v": rng.integers(0, 10_000, n)})
    pdf["v"] = pdf["v"].where(rng.random(n) < 0.2)
    pdf.loc[pdf["g"] == "c", "v"] = np.nan
    df = spark.createDataFrame(pdf.astype({"v": "Int64"}).astype(object).where(pdf.notna(), None), "g string, t long, v long")
    s = o.add_slices(df, F.col("t"), rows_per_slice=50)
    out = o.with_running_max(s, ["g"], [F.col("t")], {"v": "top"})
    out = o.with_last_known(out, ["g"], [F.col("t")], {"v": "known"}).toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "t"]).reset_index(drop=True)
    top = want.groupby("g")["v"].transform(lambda v: v.cummax().ffill().shift())
    known = want.groupby("g")["v"].ffill()
    assert (out["top"].astype(float).fillna(-1) == top.fillna(-1)).all() and (out["known"].astype(float).fillna(-1) == known.fillna(-1)).all()


def test_merged_intervals(spark):
    rng = np.random.default_rng(13)
    start = rng.integers(0, 50_000, 400)
    spans = [(int(a), int(a + b)) for a, b in zip(start, np.where(rng.random(400) < 0.05, 3000, rng.integers(0, 60, 400)))]
    spans += spans[:50]
    df = spark.createDataFrame(spans, "a long, b long").select(*[F.timestamp_seconds(c).alias(k) for c, k in (("a", "start_ts"), ("b", "end_ts"))])
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    got = labels.merge_intervals(df).select(F.unix_seconds("start_ts"), F.unix_seconds("end_ts")).collect()
    assert sorted(map(list, got)) == merged
    assert labels.merge_intervals(df.filter("false")).count() == 0


def test_codes_of_many_texts(spark):
    names = [f"phase-{i * 7919 % 5000}" for i in range(5000)]
    df = spark.createDataFrame([(x,) for x in [*names, *names[:100], None]], "phase string")
    codes = labels.code_map(df, "phase")
    got = {r["phase"]: r["code"] for r in codes.collect()}
    assert got == {x: i for i, x in enumerate(sorted({*names, "normal"}))}
    more = df.unionByName(spark.createDataFrame([("b",), ("a",)], "phase string"))
    wider = {r["phase"]: r["code"] for r in labels.extend_code_map(codes, more, "phase").collect()}
    assert wider == {**got, "a": 5001, "b": 5002}


def test_block_ordinals_with_null_streams(spark):
    rows = [(s, b, w) for s in ("x", None) for b in (None, "b1", "b2", "b10") for w in range(3 if b == "b1" else 2)]
    out = windows.with_ordinal(spark.createDataFrame(rows, "stream string, block string, win int"), "block", ["stream"]).collect()
    want = {}
    for s in ("x", None):
        inside = sorted([r for r in rows if r[0] == s], key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want.update({r: i for i, r in enumerate(inside)})
    assert {(r["stream"], r["block"], r["win"]): r["ord"] for r in out} == want
