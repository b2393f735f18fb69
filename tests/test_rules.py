"""Splits, thresholds, metrics, balancing, neighbours and run statistics: rules and known values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemetra.functions.student import t_quantile
from telemetra.operators import balance, features, labels, metrics, neighbours, runstats, splits, thresholds
from telemetra.sources import fixtures as fx
from telemetra.sources import tables


def test_block_split_properties(spark, sf):
    e = fx.ev_blocks(spark, sf)
    a = splits.deal_blocks(e, splits.PROJECT_STANDARD)
    assert splits.overlap(a, "block").count() == 0
    assert a.select("split").distinct().count() == 3
    rows = splits.attach(e, a, ["block"])
    assert rows.count() == e.count()
    by = {r["split"]: r["y"] for r in rows.groupBy("split").agg(F.sum("label").alias("y")).collect()}
    assert all(v > 0 for v in by.values())            # both classes everywhere
    again = splits.deal_blocks(fx.ev_blocks(spark, sf).repartition(13), splits.PROJECT_STANDARD)
    assert tables.mismatches(a, again).count() == 0    # independent of the partitioning
    other = splits.deal_blocks(e, splits.SplitPolicy(seed=7))
    assert tables.mismatches(a, other).count() > 0


def test_random_split_is_exact(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    s = splits.split_random(df, splits.BASE_REFERENCE, F.col("id")).groupBy("label", "split").count().collect()
    n = {(r["label"], r["split"]): r["count"] for r in s}
    assert n[0, "test"] == 180 and n[1, "test"] == 20 and n[0, "val"] == 90 and n[1, "val"] == 10


def test_scenario_without_side_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("x",)], "scenario string")
    with pytest.raises(KeyError):
        splits.assign_scenarios(df, {"a": "train"})


def test_interval_join(spark):
    iv = spark.createDataFrame([("2024-01-01 10:00:00", "2024-01-03 11:00:00"), ("2024-01-02 00:00:00", "2024-01-02 12:00:00"),
                                ("2024-01-05 00:00:00", "2024-01-05 00:00:00")], "a string, b string").select(
        F.col("a").cast("timestamp").alias("start_ts"), F.col("b").cast("timestamp").alias("end_ts"))
    rows = [("2024-01-01 09:59:59", 0), ("2024-01-01 10:00:00", 1), ("2024-01-02 06:00:00", 1), ("2024-01-03 11:00:00", 1),
            ("2024-01-03 11:00:01", 0), ("2024-01-05 00:00:00", 1), ("2024-01-05 00:00:01", 0)]
    df = spark.createDataFrame(rows, "t string, want int").withColumn("ts", F.col("t").cast("timestamp"))
    got = labels.label_by_intervals(df, "ts", iv)
    assert got.count() == len(rows)
    assert got.filter("label <> want").count() == 0


def brute_grid(p, y, grid):
    """All scores first: among the thresholds that share the best F1, the one nearest to 0.5."""
    grid = np.array(grid)
    pred = p[None, :] >= grid[:, None]
    hits = (pred & (y == 1)).sum(axis=1)
    f = 2 * hits / np.maximum(pred.sum(axis=1) + (y == 1).sum(), 1)
    near = np.flatnonzero(np.isclose(f, f.max()))
    at = near[np.argmin(np.abs(grid[near] - 0.5))]
    return grid[at], f.max()


@pytest.mark.parametrize("seed", range(4))
def test_thresholds_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = [40, 200, 500, 11][seed]
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip(np.round(rng.random(n) * 0.7 + 0.25 * y, 2), 0, 1)     # many scores sit on grid points
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    g = thresholds.grid_f1(df).first()
    t, f = brute_grid(p, y, [0.01 + i * 0.01 for i in range(99)])
    assert abs(g["threshold"] - t) < 1e-9 and abs(g["f1"] - f) < 1e-9
    e = thresholds.exact_f1(df).first()
    fs = {}
    for t in np.unique(p):
        pred = p >= t
        tp, fp, fn = (pred & (y == 1)).sum(), (pred & (y == 0)).sum(), (~pred & (y == 1)).sum()
        fs[t] = 2 * tp / (2 * tp + fp + fn)
    best = max(fs.values())
    assert abs(e["f1"] - best) < 1e-9 and fs[e["threshold"]] >= best - 1e-12
    c = thresholds.fpr_constrained(df, 0.05).first()
    ok = []
    for t in [round(0.5 + 0.01 * i, 10) for i in range(50)]:
        pred = p >= t
        fpr = (pred & (y == 0)).sum() / (y == 0).sum()
        tp, fp, fn = (pred & (y == 1)).sum(), (pred & (y == 0)).sum(), (~pred & (y == 1)).sum()
        if fpr <= 0.05:
            ok.append((2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0, tp / (y == 1).sum(), -fpr, -t))
    w = max(ok)
    assert abs(c["f1"] - w[0]) < 1e-9 and abs(c["threshold"] + w[3]) < 1e-9 and abs(c["fpr"] + w[2]) < 1e-9


def test_no_feasible_threshold(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.2)], "y int, p double")
    r = thresholds.fpr_constrained(df, 0.05).first()
    assert (r["threshold"], r["recall"], r["fpr"]) == (0.5, 0.0, 0.0)


def test_metric_values(spark):
    y, q = [1, 1, 1, 1, 0, 0, 0, 0], [0.9, 0.8, 0.7, 0.1, 0.6, 0.2, 0.3, 0.1]
    df = spark.createDataFrame(list(zip(y, q)), "y int, p double").withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    r = metrics.with_rates(metrics.confusion_counts(df)).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 1, 1, 3)
    assert r["precision"] == r["recall"] == r["f1"] == 0.75 and r["fpr"] == 0.25
    pos, neg = [a for a, b in zip(q, y) if b], [a for a, b in zip(q, y) if not b]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(metrics.roc_auc(df).first()["roc_auc"] - auc) < 1e-12
    assert metrics.roc_auc(df.filter("y = 1")).first()["roc_auc"] == 0.5


def test_balancing(spark):
    df = spark.range(500).select("id", (F.col("id") % 7 == 0).cast("int").alias("label"))
    n1 = df.filter("label = 1").count()
    u = balance.undersample(df, 2.0, F.col("id"), 1)
    assert u.filter("label = 1").count() == n1 and u.filter("label = 0").count() == 2 * n1
    flipped = df.withColumn("label", 1 - F.col("label"))
    v = balance.undersample(flipped, 1.0, F.col("id"), 1)
    assert v.filter("label = 0").count() == n1 and v.filter("label = 1").count() == n1
    o = balance.oversample(df, F.col("id"), 1).groupBy("label").count().collect()
    assert len({r["count"] for r in o}) == 1


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 3)), 2)
    x = np.vstack([x, np.tile(x[:1], (150, 1))])       # one vector holds a third of the rows
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = neighbours.knn(df, ["a", "b", "c"], 5, leaf=40, group=30).toPandas()
    assert len(got) == len(np.unique(x, axis=0))
    for r in got.itertuples(index=False):
        d = np.sort(np.sqrt(((x - np.array([r.a, r.b, r.c])) ** 2).sum(1)))[1:6]
        assert np.allclose(d, r.distances)


def test_tied_neighbours_do_not_depend_on_the_cells(spark):
    """On a grid most distances are tied: the smaller vector wins, whatever the cells and groups."""
    x = np.array([(a, b) for a in range(18) for b in range(18)], float)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(5)
    for leaf, group in ((1_000, 1_000), (20, 15)):
        got = {(r.a, r.b): [tuple(v) for v in r.neighbours] for r in neighbours.knn(df, ["a", "b"], 6, leaf, group).collect()}
        for q in x:
            want = sorted((float(np.sqrt(((q - v) ** 2).sum())), *v) for v in x if (v != q).any())[:6]
            assert got[tuple(q)] == [w[1:] for w in want]


def test_cells_within_a_radius(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(2_000, 3)), rng.normal(size=(200, 3))
    cells, radius = neighbours.Cells(x, 6), rng.uniform(0, 2, 200)
    lo, hi = cells.lo[cells.n - 1:], cells.hi[cells.n - 1:]
    row, cell = cells.within(q, radius)
    gap = np.maximum(np.maximum(lo - q[:, None], q[:, None] - hi), 0)
    assert set(zip(row.tolist(), cell.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(np.sqrt((gap ** 2).sum(2)) <= radius[:, None]))))
    assert len(row) < 200 * 64


def test_smote_makes_copies_after_the_join(spark):
    """Each base row is joined with its neighbours once or twice, not once per copy, and no position is numbered."""
    pdf = pd.DataFrame({"a": [float(i) for i in range(300)], "label": [1] * 20 + [0] * 280})
    s = neighbours.smote(spark.createDataFrame(pdf), ["a"], F.col("a").cast("string"), 3)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("Join") and "row_number" not in plan
    got = s.groupBy("base_a").agg(F.count(F.lit(1)).alias("n"), F.collect_list("copy").alias("c")).collect()
    assert len(got) == 20 and sum(r["n"] for r in got) == 260 and all(sorted(r["c"]) == list(range(13)) for r in got)


def test_missing_features_have_no_neighbours(spark):
    for odd in (None, float("nan")):
        df = spark.createDataFrame([(1.0, 2.0), (2.0, odd), (3.0, 1.0)], "a double, b double")
        with pytest.raises(ValueError):
            neighbours.knn(df, ["a", "b"], 1)
    assert neighbours.knn(df.filter("not isnan(b)"), ["a", "b"], 1).count() == 2


def test_window_resplit_by_group(spark):
    w = spark.createDataFrame([(u, i, i % 2) for u in [*range(20), None] for i in range(3)], "ue int, win int, y int")
    got = splits.resplit_windows(w, splits.SplitPolicy("group", 0.2, 0.1), "group", key=F.col("win"), group="ue").collect()
    sides = {}
    for r in got:
        sides.setdefault(r["ue"], set()).add(r["split"])
    assert len(got) == 63 and len(sides) == 21 and all(len(s) == 1 for s in sides.values())
    n = [sum(s == {x} for s in sides.values()) for x in ("test", "val", "train")]
    assert n == [5, 2, 14]
    with pytest.raises(ValueError):
        splits.resplit_windows(w, splits.SplitPolicy("group", 0.2, 0.1), "other", key=F.col("win"))


def test_undersample_keeps_the_first_of_the_shuffle_without_moving_rows(spark):
    """The same rows as by a rank over all digests, also where rows of one digest straddle the cut; no row is shuffled."""
    from telemetra.functions.seeded import shuffle_key
    df = spark.range(30_000).select((F.col("id") % 7_000).alias("k"), "id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    ranked = df.filter("label = 0").select("id", shuffle_key(3, F.col("id")).alias("h")).toPandas().sort_values("h")
    got, sizes = balance.undersampled(df, 2.5, F.col("id"), 3)
    assert {r["id"] for r in got.filter("label = 0").collect()} == set(ranked["id"][:7_500])
    assert sizes == {1: 3_000, 0: 7_500} and got.filter("label = 1").count() == 3_000
    assert "Window" not in got._jdf.queryExecution().toString() and "Exchange" not in got._jdf.queryExecution().toString()
    for ratio in (0.0, 1.0, 2.0, 2.0005, 2.001, 9.0, 20.0):
        u = balance.undersample(df, ratio, F.col("k"), 3)
        assert u.filter("label = 0").count() == min(27_000, round(3_000 * ratio)) and u.select("id").distinct().count() == u.count()


def test_smote_counts_and_convexity(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(120, 2)), columns=["a", "b"]).assign(label=[1] * 25 + [0] * 95)
    df = spark.createDataFrame(pdf)
    s = neighbours.smote(df, ["a", "b"], F.concat_ws("|", "a", "b"), 3).toPandas()
    assert len(s) == 95 - 25 and (s["label"] == 1).all()
    for r in s.itertuples():
        for v, b, o in ((r.a, r.base_a, r.neighbour[0]), (r.b, r.base_b, r.neighbour[1])):
            assert min(b, o) - 1e-12 <= v <= max(b, o) + 1e-12


def test_t_quantiles():
    for df, want in ((1, 12.7062047), (4, 2.7764451), (9, 2.2621572), (19, 2.0930241), (600, 1.9639256)):
        assert abs(t_quantile(0.975, df) - want) < 1e-6


def paired_frame(spark, prop, base, metric="f1"):
    rows = [("d", "standard", metric, i, float(a), "base", float(b)) for i, (a, b) in enumerate(zip(prop, base))]
    return spark.createDataFrame(rows, "dataset string, split_policy string, metric string, seed int, proposed double, "
                                       "baseline_method string, baseline double")


def p_of(spark, prop, base, metric="f1"):
    t = runstats.signed_rank(paired_frame(spark, prop, base, metric), ["dataset", "metric", "baseline_method"])
    return runstats.p_values(t).first()


def test_wilcoxon_known_values(spark):
    r = p_of(spark, [0.6, 0.7, 0.8, 0.9, 1.0], [0.5, 0.58, 0.65, 0.72, 0.8])
    assert r["exact"] and abs(r["p_value"] - 1 / 32) < 1e-12          # all five positive
    assert min(1.0, r["p_value"] * 14) == 0.4375
    r = p_of(spark, np.arange(20) * 0.011 + 0.5 + np.arange(20) ** 2 * 1e-4 + 0.001, np.full(20, 0.5))
    assert abs(r["p_value"] - 2.0 ** -20) < 1e-15
    assert p_of(spark, [0.5] * 6, [0.5] * 6)["p_value"] == 1.0
    # ties: normal approximation with the tie correction
    r = p_of(spark, [0.6] * 4 + [0.4], [0.5] * 5)
    w, n, var = 4 * 3.0, 5, 5 * 6 * 11 / 24 - (125 - 5) / 48
    from statistics import NormalDist
    assert not r["exact"] and abs(r["p_value"] - (1 - NormalDist().cdf((w - n * (n + 1) / 4) / var ** 0.5))) < 1e-9
    # lower is better: direction turns
    r = p_of(spark, [0.1, 0.2, 0.3, 0.35], [0.2, 0.32, 0.45, 0.6], "fpr")
    assert r["alternative"] == "less" and abs(r["p_value"] - 1 / 16) < 1e-12


def test_summary_of_one_to_five(spark):
    long = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5]] + [(float("nan"),)], "value double")
    long = long.withColumn("value", F.when(~F.isnan("value"), F.col("value"))).withColumn("k", F.lit(1))
    r = runstats.summarize(long, ["k"]).first()
    assert r["n"] == 5 and r["mean"] == 3.0 and abs(r["std"] - 2.5 ** 0.5) < 1e-12
    half = 2.7764451052 * (2.5 / 5) ** 0.5
    assert abs(r["ci_low"] - (3 - half)) < 1e-6


def test_seed_specs(spark):
    def parse(s):
        return spark.range(1).select(runstats.parse_seeds(F.lit(s)).alias("x")).first()["x"]
    assert parse("1-3,42,2") == [1, 2, 3, 42] and parse("7") == [7]
    with pytest.raises(Exception, match="invalid seed range"):
        parse("5-3")


# --- feature tables and files ---------------------------------------------------

# Raw column names, by family.
CELL = """cqi dl_bitrate dl_err dl_mcs dl_retx dl_tx epre initial_ta p_ue pusch_snr ri turbo_decoder_avg turbo_decoder_max
turbo_decoder_min ul_bitrate ul_err ul_mcs ul_n_layer ul_path_loss ul_phr ul_rank ul_retx ul_tx cell_id""".split()
OTHER = """_time imeisv 5g_tmsi amf_ue_id bearer_0_apn bearer_0_dl_total_bytes bearer_0_ip bearer_0_ipv6
bearer_0_pdu_session_id bearer_0_qos_flow_id bearer_0_sst bearer_0_ul_total_bytes bearer_1_apn bearer_1_dl_total_bytes
bearer_1_ip bearer_1_ipv6 bearer_1_pdu_session_id bearer_1_qos_flow_id bearer_1_sst bearer_1_ul_total_bytes dl_bitrate ran_id
ran_plmn ran_ue_id registered rnti t3512 tac tac_plmn ue_aggregate_max_bitrate_dl ue_aggregate_max_bitrate_ul ul_bitrate""".split()
RAW = OTHER + [f"cell_{n}_{m}" for n in (1, 3) for m in CELL]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    n = 60
    pdf = pd.DataFrame({c: rng.normal(size=n).round(3) for c in RAW})
    pdf["_time"] = [str(t) for t in pd.date_range("2024-08-18 06:30", periods=n, freq="30s")]
    pdf.loc[5, "_time"] = "garbage"
    for c in tables.RAW_STRING_COLUMNS[1:]:
        pdf[c] = "x"
    for c in pdf.columns:
        if c.startswith("cell_"):
            pdf.loc[(np.arange(n) % 2 == 0) == c.startswith("cell_1"), c] = np.nan
    path = tmp_path_factory.mktemp("raw") / "t.csv"
    pdf.to_csv(path, index=False)
    return pdf, tables.load_telemetry(spark, str(path), list(pdf.columns))


def test_load_and_feature_sets(raw):
    pdf, df = raw
    assert len(RAW) == 80 and df.count() == len(pdf) - 1           # the unparseable row is dropped
    t = features.select_features(df, features.TABLE_FEATURES, features.TABLE_ALIASES)
    assert t.columns == features.TABLE_FEATURES and len(t.columns) == 38
    a = [r["ul_retx"] for r in t.select("ul_retx").collect()]
    want = pdf.drop(index=5)[["cell_1_ul_retx", "cell_3_ul_retx"]].max(axis=1)
    assert np.allclose(a, want)
    dev = features.select_features(df, ["ul_bitrate"], bitrate="device")
    assert np.allclose([r[0] for r in dev.collect()], pdf.drop(index=5)["ul_bitrate"])
    s = features.retx_feature_set(df)
    assert {"ul_retx_max", "dl_retx_max"} <= set(s.columns) and not any(c.endswith("_apn") for c in s.columns)
    assert len(s.columns) == 62            # 49 once the 13 constant columns are gone
    with pytest.raises(KeyError):
        features.select_features(df, ["nope"])


def test_scenario_folders_and_run_files(spark, tmp_path):
    for s in ("S0", "S1"):
        (tmp_path / "sc" / s).mkdir(parents=True)
        pd.DataFrame({"timestamp": ["2024-01-01"] * 3, "v": [1, 2, 3]}).to_csv(tmp_path / "sc" / s / "dataset.csv", index=False)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("v", T.DoubleType())])
    got = tables.load_scenarios(spark, str(tmp_path / "sc"), schema).groupBy("scenario").count().collect()
    assert {r["scenario"]: r["count"] for r in got} == {"S0": 3, "S1": 3}
    cols = ["dataset", "method", "config", "split_policy", "seed", "f1"]
    for seed, rows in ((1, [("a", "m", "c", "s", 1, 0.5), ("a", "m", "c", "s", 1, 0.6)]), (2, [("a", "m", "c", "s", 2, "bad")])):
        (tmp_path / f"seed_{seed}").mkdir()
        pd.DataFrame(rows, columns=cols).to_csv(tmp_path / f"seed_{seed}" / "m_results.csv", index=False)
    r = {x["seed"]: x["f1"] for x in tables.load_runs(spark, str(tmp_path), cols, ["f1"]).collect()}
    assert r == {1: 0.6, 2: None}


def test_result_documents(spark, tmp_path):
    df = spark.createDataFrame([("P6", 0.9, [(0, 0.1), (1, 0.2)])],
                               "config string, f1 double, windows array<struct<win:int,fpr:double>>")
    tables.write_documents(df, str(tmp_path / "doc"))
    back = spark.read.schema(df.schema).json(str(tmp_path / "doc")).first()
    assert back["config"] == "P6" and back["windows"][1]["fpr"] == 0.2
    tables.write_windows(df.select("windows"), str(tmp_path / "win"))
    assert spark.read.parquet(str(tmp_path / "win")).count() == 1
    assert tables.as_result_rows(df).columns == [f.name for f in tables.RESULT_SCHEMA.fields]
    assert len(tables.RESULT_SCHEMA.fields) == 24


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, True)], "`Profile.timestamp` double, `a.b` double, ok boolean")
    assert features.numeric_features(df.schema) == ["a.b"]
    assert features.consolidate(df).columns == df.columns


def test_combined_run_file_is_read_last(spark, tmp_path):
    cols = ["dataset", "method", "config", "split_policy", "seed", "f1"]
    (tmp_path / "seed_1").mkdir()
    pd.DataFrame([["d", "m", "c", "p", s, 0.1] for s in (1, 2)], columns=cols).to_csv(tmp_path / "seed_1" / "m_results.csv", index=False)
    alone = tables.load_runs(spark, str(tmp_path), cols, ["f1"]).collect()
    assert sorted((r["seed"], r["f1"]) for r in alone) == [(1, 0.1), (2, 0.1)]
    pd.DataFrame([[0.9, "d", "m", "c", "p", 2], [0.8, "d", "m", "c", "p", 3]], columns=["f1", *cols[:-1]]).to_csv(
        tmp_path / "multiseed_all_runs.csv", index=False)
    got = tables.load_runs(spark, str(tmp_path), cols, ["f1"]).collect()
    assert sorted((r["seed"], r["f1"]) for r in got) == [(1, 0.1), (2, 0.9), (3, 0.8)]


def test_headers_of_many_files_take_a_fixed_number_of_jobs(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.StringType())])
    tracker, jobs = spark.sparkContext.statusTracker(), []
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    for n in (8, 60):
        root = tmp_path / f"n {n}+1"             # names that need escapes
        root.mkdir()
        for i in range(n):
            cols = ("a,b", "b,c,a", "a,\"b\"")[i % 3]
            row = {"a": f"{i}.5", "b": f"t{i}", "c": "z", '"b"': f"t{i}"}
            lines = [cols, *[",".join(row[c] for c in cols.split(","))] * 40]
            (root / f"f{i}.csv").write_text("\n" * (i % 2) + "\n".join(lines))
        (root / "empty.csv").write_text("")
        spark.sparkContext.setJobGroup(f"heads{n}", "heads")
        df = tables.csv_by_name(spark, str(root), schema)
        jobs.append(len(tracker.getJobIdsForGroup(f"heads{n}")))
        spark.sparkContext.setJobGroup("rest", "rest")
        got = df.groupBy("a", "b").count().collect()
        assert sorted((r["a"], r["b"], r["count"]) for r in got) == [(i + 0.5, f"t{i}", 40) for i in range(n)]
    assert jobs[0] == jobs[1]
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    with pytest.raises(ValueError):
        tables.csv_by_name(spark, str(root), T.StructType([T.StructField("nope", T.StringType())]))


def test_a_job_written_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "jobs")
    rows = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.6), ("n", None, 0.7), ("n", 1, 0.8)], "method string, seed int, f1 double")
    for method, seed in (("m", 1), ("m", 2), ("n", None), ("m", 1), ("n", None), ("x", 9)):
        tables.append_job(path, rows, {"seed": seed, "method": method})
    got = tables.read_jobs(spark, path)
    assert got.columns == tables.RESULT_SCHEMA.names
    assert sorted((r["method"], r["seed"] or 0, r["f1"]) for r in got.collect()) == [("m", 1, 0.5), ("m", 2, 0.6), ("n", 0, 0.7)]
