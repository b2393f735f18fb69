"""Chunked folds equal the sequential recursion; streaming equals batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemetra.operators import online
from telemetra.sources import fixtures as fx
from telemetra.streaming import streams


def cusum_loop(scores, mean, std, k=0.5, h=5.0):
    s, out = 0.0, []
    for v in scores:
        s = max(0.0, s + (v - mean) / std - k)
        alarm = s >= h
        s = 0.0 if alarm else s
        out.append((s, int(alarm)))
    return out


@pytest.mark.parametrize("chunk", [7, 50, 4096])
def test_cusum_chunks(spark, chunk):
    rng = np.random.default_rng(4)
    rows = []
    for key in ("a", "b"):
        x = rng.normal(0, 1, 200)
        x[60:90] += 2.5
        x[150:] += 0.8                # long climbs across chunk borders
        rows += [(key, i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "stream string, ord long, score double")
    det = online.Cusum(0.0, 1.0)
    got = online.cusum_alarms(df, ["stream"], "ord", "score", det, chunk).toPandas()
    assert len(got) == 400
    for key, g in got.sort_values("ord").groupby("stream"):
        want = cusum_loop([r[2] for r in rows if r[0] == key], 0.0, 1.0)
        assert g["alarm"].tolist() == [a for _, a in want]
        assert np.allclose(g["cusum"], [s for s, _ in want], atol=1e-12)


def test_cusum_never_forgetting_input(spark):
    """No clamp and no alarm ever: each pass fixes one more chunk and the result is still exact."""
    x = [0.51] * 60
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "ord long, score double")
    got = online.cusum_alarms(df, [], "ord", "score", online.Cusum(0.0, 1.0), 10).toPandas().sort_values("ord")
    assert np.allclose(got["cusum"], [s for s, _ in cusum_loop(x, 0, 1)], atol=1e-12)


@pytest.mark.parametrize("chunk", [9, 4096])
def test_gate_and_ewma_chunks(spark, chunk):
    rng = np.random.default_rng(5)
    n, f = 120, 3
    r = np.clip(rng.normal(0.2, 0.15, (n, f)), -1, 1)
    r[70:80] += 0.7
    benign = np.where(rng.random(n) < 0.8, 1.0, 0.5)
    size = np.where(np.arange(n) == 30, 1, 50)
    df = spark.createDataFrame(pd.DataFrame({"ord": range(n), "r": r.tolist(), "benign_fraction": benign, "n": size}))
    det = online.Cusum(0.4, 0.15)
    got = online.gated_adaptation(df, [], "ord", [0.2] * f, det, 0.05, 0.9, chunk).toPandas().sort_values("ord")
    base, s = np.full(f, 0.2), 0.0
    for i in range(n):
        v = np.sqrt(2 * ((r[i] - base) ** 2).sum()) if size[i] >= 2 else 0.0
        s = max(0.0, s + (v - 0.4) / 0.15 - 0.5)
        alarm = s >= 5
        s = 0.0 if alarm else s
        upd = not alarm and benign[i] >= 0.9 and size[i] >= 2
        row = got.iloc[i]
        assert (row["alarm"], row["updated"]) == (int(alarm), int(upd))
        assert abs(row["divergence"] - v) < 1e-9 and abs(row["cusum"] - s) < 1e-9
        if upd:
            base = 0.05 * r[i] + 0.95 * base
    end = online.gated_adaptation(df, [], "ord", [0.2] * f, det, 0.05, 0.9, chunk, end_state=True).first()["state"]
    assert np.allclose(end[1:], base, atol=1e-9)
    b = online.ewma_baseline(df, [], "ord", "r", 0.1, chunk=chunk).first()["state"]
    e = r[0]
    for i in range(1, n):
        e = 0.1 * r[i] + 0.9 * e if size[i] >= 2 else e      # one row alone changes nothing
    assert np.allclose(b, e, atol=1e-9)


def test_calibration_edges(spark):
    one = spark.createDataFrame([(3.0,)], "s double")
    d = online.calibrate(one, "s")
    assert (d.mean, d.std) == (3.0, 1.0)
    with pytest.raises(ValueError):
        online.calibrate(one.limit(0), "s")
    with pytest.raises(ValueError):
        online.calibrate(spark.createDataFrame([(1.0,), (float("nan"),)], "s double"), "s")


def _land(spark, folder, batches):
    """One file per batch, in order of modification time."""
    import os
    import time
    for i, b in enumerate(batches):
        b.to_parquet(os.path.join(folder, f"b{i}.parquet"), coerce_timestamps="us")
        os.utime(os.path.join(folder, f"b{i}.parquet"), (time.time() - 1000 + 10 * i,) * 2)


def test_late_rows_are_dropped(spark, tmp_path):
    def batch(minutes):
        return pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, "m"), "label": 0})
    # minute 290 is late but within the watermark; minute 10 comes after its window was closed
    _land(spark, str(tmp_path), [batch([0, 5, 30]), batch([300, 305]), batch([290]), batch([10]), batch([600])])
    s = streams.stream_table(spark, str(tmp_path), "*.parquet", "ts timestamp_ntz, label long", files_per_batch=1)
    s = s.select(F.col("ts").cast("timestamp").alias("ts"), "label")
    got = streams.drain(streams.window_counts(s, "60 minutes", "20 minutes"), "late").toPandas()
    n = dict(zip(got["start_ts"].dt.strftime("%H:%M"), got["n"]))
    assert n["00:00"] == 2 and n["00:20"] == 1      # the late row at minute 10 is gone
    assert n["04:40"] == 1 and n["05:00"] == 2


def test_stream_state_spans_batches(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(0.4, 1, 60)
    pdf = pd.DataFrame({"k": "a", "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(range(60), "h"), "score": x})
    _land(spark, str(tmp_path), [pdf.iloc[:20].sample(frac=1, random_state=0), pdf.iloc[20:45], pdf.iloc[45:]])
    s = streams.stream_table(spark, str(tmp_path), "*.parquet", "k string, t timestamp_ntz, score double", 1)
    s = s.select("k", F.col("t").cast("timestamp").alias("t"), "score")
    got = streams.drain(streams.cusum(s, "k", "t", "score", online.Cusum(0.0, 1.0)), "c").toPandas().sort_values("t")
    want = cusum_loop(x, 0, 1)
    assert got["alarm"].tolist() == [a for _, a in want]
    assert np.allclose(got["cusum"], [v for v, _ in want])


def test_batch_and_stream_labels_agree(spark, sf):
    from telemetra.plans.streams import stream_interval_label
    a = stream_interval_label(spark, sf)
    b = fx.ev(spark, sf).select("event_id", "label")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_gate_passes_do_not_grow_with_the_chunks(spark, monkeypatch):
    """The carried state forgets, so chunks of one length settle after the same few passes, however many there are."""
    from telemetra.operators import scan
    f, chunk, made = 3, 60, []
    store, tables = scan.materialize, []
    monkeypatch.setattr(scan, "materialize", lambda t: (tables.append(1), store(t))[1])
    det = online.Cusum(0.4, 0.15)
    for chunks in (8, 16):
        rng, n = np.random.default_rng(9), chunks * chunk
        r = np.clip(rng.normal(0.2, 0.1, (n, f)), -1, 1)
        df = spark.createDataFrame(pd.DataFrame({"ord": range(n), "r": r.tolist(), "benign_fraction": 1.0, "n": 50})).repartition(8)
        whole = online.gated_adaptation(df, [], "ord", [0.2] * f, det, 0.2, chunk=n).toPandas().sort_values("ord")
        tables.clear()
        got = online.gated_adaptation(df, [], "ord", [0.2] * f, det, 0.2, chunk=chunk).toPandas().sort_values("ord")
        assert got["alarm"].tolist() == whole["alarm"].tolist() and np.allclose(got["divergence"], whole["divergence"], atol=1e-9)
        made.append(len(tables))
    assert made[1] <= made[0] + 3
