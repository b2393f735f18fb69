"""Scans, sinks, projections and predicates over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.functions.numeric import ratio
from telemetra.functions.seeded import shuffle_key
from telemetra.operators import features, labels, splits
from telemetra.operators.ordering import add_slices, with_position
from telemetra.plans.registry import frac, query, r6
from telemetra.session import materialize, shared_path
from telemetra.sources import fixtures as fx
from telemetra.sources import tables

@query("scan_telemetry", f"""with {fx.EV_SQL}
select event_id, epoch_us(ts) as ts_us, user_id, event_type, f1, f2, label from ev""")
def scan_telemetry(spark, d):
    """Events written as CSV in another column order, with a row that has no time, and loaded again."""
    e = fx.table(spark, d, "events").select(
        F.col("value").alias("f1"), F.col("event_type").alias("bearer_0_apn"), F.col("event_id").cast("double").alias("rnti"),
        F.col("ts").cast("string").alias("_time"), F.get_json_object("props", "$.k").cast("double").alias("f2"),
        F.col("user_id").cast("double").alias("imeisv"), F.lit("x").alias("unused"))
    path = shared_path(spark, "telemetry")
    odd = e.limit(1).withColumn("_time", F.lit("not-a-time"))
    e.unionByName(odd).write.option("header", True).csv(path)
    t = tables.load_telemetry(spark, path, ["_time", "imeisv", "bearer_0_apn", "rnti", "f1", "f2"])
    return t.select(F.col("rnti").cast("long").alias("event_id"), fx.micros("_time").alias("ts_us"),
                    F.col("imeisv").cast("long").alias("user_id"), F.col("bearer_0_apn").alias("event_type"), "f1", "f2",
                    labels.interval_flag(F.col("_time"), fx.EVENT_ATTACKS).alias("label"))


@query("coerce_timestamp", """
select event_id, epoch_us(t) as ts_us from (
  select event_id, try_cast(case when event_id % 97 = 0 then 'not-a-time' else cast(ts as varchar) end
                            as timestamp) as t from events) where t is not null""")
def coerce_timestamp(spark, d):
    text = F.when(F.col("event_id") % 97 == 0, "not-a-time").otherwise(F.col("ts").cast("string"))
    raw = fx.table(spark, d, "events").select("event_id", text.alias("_time"))
    return tables.coerce_time(raw, "_time").select("event_id", F.unix_micros("_time").alias("ts_us"))


@query("scenario_union", f"""with {fx.EV_SQL}
select event_id, event_type as scenario,
       row_number() over (partition by event_type order by ts, event_id) - 1 as pos from ev""")
def scenario_union(spark, d):
    """One CSV folder per event type, every other one in another column order, loaded as tagged scenarios."""
    e = fx.ev(spark, d).select("event_id", fx.micros().alias("ts_us"), "event_type")
    root = shared_path(spark, "scenarios")
    names = sorted(r[0] for r in e.select("event_type").distinct().collect())    # class names
    for i, t in enumerate(names):
        cols = ["event_id", "ts_us"][:: -1 if i % 2 else 1]
        e.filter(F.col("event_type") == t).select(*cols).write.option("header", True).csv(f"{root}/{t}/dataset.csv")
    u = tables.load_scenarios(spark, root, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType())]))
    u = add_slices(u, F.col("ts_us"), F.col("event_id"))
    return with_position(u, ["scenario"], ["ts_us", "event_id"]).select("event_id", "scenario", "pos")


@query("sequence_index", f"""with {fx.EV_SQL}
select row_number() over (order by ts, event_id) - 1 as row_id, epoch_us(ts) as ts_us, user_id from ev""")
def sequence_index(spark, d):
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    return with_position(e, [], fx.EV_ORDER, "row_id").select(
        "row_id", fx.micros().alias("ts_us"), "user_id")


@query("phase_codes", """
with t as (select event_id, coalesce(event_type, 'normal') as phase,
                  epoch_us(ts) < epoch_us(timestamp '2024-01-16 00:00:00') and event_type <> 'signup' as old
           from events),
known as (select phase, row_number() over (order by phase) - 1 as code from (select distinct phase from t where old)),
fresh as (select phase, row_number() over (order by phase) - 1 + (select count(*) from known) as code
          from (select distinct phase from t where phase not in (select phase from known)))
select phase, code, cast(count(*) as bigint) as n from t join (select * from known union all select * from fresh)
using (phase) group by all""")
def phase_codes(spark, d):
    """Codes fitted on the first half (without sign-ups); the new phase gets a fresh code."""
    e = fx.ev(spark, d).select("ts", F.coalesce("event_type", F.lit("normal")).alias("phase"))
    fit = e.filter((F.col("ts") < F.lit("2024-01-16").cast("timestamp")) & (F.col("phase") != "signup"))
    codes = labels.extend_code_map(labels.code_map(fit, "phase"), e, "phase")
    return e.groupBy("phase").agg(F.count(F.lit(1)).alias("n")).join(codes, "phase").select(
        "phase", F.col("code").cast("long").alias("code"), "n")


@query("parse_bool_label", f"""with {fx.EV_SQL}
select event_id, case when lower(case when label = 1 then (case when event_id % 2 = 0 then 'True' else 'TRUE' end)
       else 'False' end) = 'true' then 1 else 0 end as label from ev""")
def parse_bool_label(spark, d):
    text = F.when(F.col("label") == 1, F.when(F.col("event_id") % 2 == 0, "True").otherwise("TRUE")) \
            .otherwise("False")
    return fx.ev(spark, d).select("event_id", labels.bool_label(text).alias("label"))


@query("coerce_numeric", """
select event_id, try_cast(case when event_id % 11 = 0 then 'n/a' else json_extract_string(props, '$.k') end
                          as double) as k from events""")
def coerce_numeric(spark, d):
    raw = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "n/a")
                                              .otherwise(F.get_json_object("props", "$.k")).alias("t"))
    return raw.select("event_id", F.expr("try_cast(t as double)").alias("k"))


@query("apply_threshold", f"""with {fx.SCORED_SQL}
select event_id, case when p >= 0.35 then 1 else 0 end as pred from scored""")
def apply_threshold(spark, d):
    return fx.scored(spark, d).select("event_id", F.when(F.col("p") >= 0.35, 1).otherwise(0).alias("pred"))


_CELL = ", ".join(fx.LI_KEYS[1:5])


@query("feature_select", f"""with {fx.CELLS_SQL}
select {_CELL}, greatest(cell_1_x, cell_3_x) as traffic, greatest(cell_1_m, cell_3_m) as m,
       greatest(cell_1_ul_retx, cell_3_ul_retx) as ul_retx, t3512 from cells""")
def feature_select(spark, d):
    c = fx.cells(spark, d).drop("ts", "f1", "f2", "f3", "f4", "label")
    return features.select_features(c, ["traffic", "m", "ul_retx", "t3512"], {"traffic": "x"},
                                    keep=fx.LI_KEYS[1:5])


@query("consolidate_cells", f"""with {fx.CELLS_SQL}
select {_CELL}, imeisv, t3512, bearer_0_apn, greatest(cell_1_m, cell_3_m) as m,
       greatest(cell_1_ul_retx, cell_3_ul_retx) as ul_retx, greatest(cell_1_x, cell_3_x) as x from cells""")
def consolidate_cells(spark, d):
    c = fx.cells(spark, d).drop("ts", "f1", "f2", "f3", "f4", "label", "split")
    return features.consolidate(c)


@query("feature_set_retx", f"""with {fx.CELLS_SQL},
med as (select median(cell_1_m) as a, median(cell_3_m) as b, median(cell_1_x) as c, median(cell_3_x) as e from cells)
select {_CELL}, t3512, coalesce(cell_1_m, a) as cell_1_m, coalesce(cell_3_m, b) as cell_3_m,
       coalesce(cell_1_x, c) as cell_1_x, coalesce(cell_3_x, e) as cell_3_x,
       greatest(cell_1_ul_retx, cell_3_ul_retx) as ul_retx_max from cells, med""")
def feature_set_retx(spark, d):
    from telemetra.operators import cleaning
    c = fx.cells(spark, d).drop("ts", "f1", "f2", "f3", "f4", "label", "split")
    t = features.retx_feature_set(c)
    sparse = [x for x in t.columns if x.startswith("cell_")]
    return cleaning.impute(t, cleaning.medians(t, sparse))


@query("numeric_features", f"""with {fx.EV_SQL}
select 'f1' as feature, count(f1) filter (event_id % 7 <> 0) as n from ev union all select 'f2', count(f2) from ev
union all select 'user_id', count(user_id) from ev""")
def numeric_features(spark, d):
    """Schema-driven choice, reported with the number of non-null values behind it."""
    e = (fx.ev(spark, d).withColumn("f1", F.when(F.col("event_id") % 7 != 0, F.col("f1"))).withColumn("Profile.timestamp", F.lit(1.0))
         .withColumn("Attacker.event", F.lit(1)))
    names = features.numeric_features(e.schema, exclude=["event_id", "label"])
    counts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n")) for n in names])
    return e.agg(*[F.count(n).alias(n) for n in names]).select(F.inline(counts))


@query("drop_incomplete", f"""with {fx.CELLS_SQL}
select {_CELL}, cell_1_m, cell_1_x from cells where cell_1_m is not null and cell_1_x is not null""")
def drop_incomplete(spark, d):
    return fx.cells(spark, d).select(*fx.LI_KEYS[1:5], "cell_1_m", "cell_1_x").na.drop()


@query("stratified_sample", f"""with {fx.EV_SQL},
h as (select event_id, label, md5('7|' || event_id) as h from ev),
r as (select *, row_number() over (partition by label order by h) as rk, count(*) over (partition by label) as nc,
             count(*) over () as n from h),
q as (select event_id, label, h, rk, least(nc, greatest(1, cast(round_even(500 * nc / cast(n as double), 0) as bigint))) as quota from r),
chosen as (select *, row_number() over (order by (rk > quota), h) as g from q)
select event_id, label from chosen where g <= 500""")
def stratified_sample(spark, d):
    """500 rows: class quotas first, then the next rows of the shuffle fill up or drop out."""
    e = fx.ev(spark, d).select("event_id", "label")
    want = 500
    sizes = splits.class_sizes(e, "label")
    n = sum(sizes.values())
    quota = {c: min(k, max(1, round(want * k / n))) for c, k in sizes.items()}
    ranked = splits.shuffled_positions(e, ["label"], F.col("event_id"), 7, rows=n)
    over = F.col("rk") >= splits.by_class("label", quota)
    return (ranked.orderBy(over, shuffle_key(7, F.col("event_id"))).limit(want)
            .select("event_id", "label"))


@query("window_sample", f"""with {fx.EVW_SQL}
select event_id, block, win from (
  select *, row_number() over (partition by block, win order by md5('11|' || event_id)) as rk from evw)
where rk <= 5""")
def window_sample(spark, d):
    """Five rows of each window; a window has a fixed number of rows."""
    from pyspark.sql import Window as W
    w = W.partitionBy("block", "win").orderBy(shuffle_key(11, F.col("event_id")))
    return (fx.ev_windows(spark, d).withColumn("rk", F.row_number().over(w))
            .filter(F.col("rk") <= 5).select("event_id", "block", "win"))


@query("row_alignment", f"""with {fx.EV_SQL},
a as (select event_id, label from ev where event_id % 89 <> 0),
b as (select event_id, case when event_id % 53 = 0 then 1 - label else label end as label from ev where event_id % 97 <> 0)
select count(*) as n_rows, count(*) filter (a.event_id is null) as missing_left, count(*) filter (b.event_id is null) as missing_right,
       count(*) filter (a.label <> b.label) as label_differs from a full join b on a.event_id = b.event_id""")
def row_alignment(spark, d):
    """Two tables of the same rows, with rows missing on either side and labels changed on one."""
    e = fx.ev(spark, d).select("event_id", "label")
    a = e.filter("event_id % 89 <> 0").select("event_id", F.col("label").alias("ya"))
    b = e.filter("event_id % 97 <> 0").select(
        "event_id", F.when(F.col("event_id") % 53 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("yb"))
    return a.join(b, "event_id", "full_outer").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("ya").isNull(), 1)).alias("missing_left"),
        F.count(F.when(F.col("yb").isNull(), 1)).alias("missing_right"),
        F.count(F.when(F.col("ya") != F.col("yb"), 1)).alias("label_differs"))


@query("result_rows", f"""with {fx.RUNS_SQL}
select dataset, method, config, split_policy, seed, precision, recall, f1, fpr, accuracy, roc_auc,
       'validation' as threshold_selected_on, inference_latency_ms from runs""")
def result_rows(spark, d):
    """Append to the result table in two writes and read the filled columns back."""
    path = shared_path(spark, "results")
    r = tables.latest_runs(fx.runs_raw(spark, d)).withColumn("threshold_selected_on", F.lit("validation"))
    tables.append_results(r.filter(F.col("method") == "base"), path)
    tables.append_results(r.filter(F.col("method") != "base"), path)
    stored = spark.read.schema(tables.RESULT_SCHEMA).parquet(path)
    return stored.drop("feature_set", "weighted_f1", "tp", "fp", "fn", "tn", "threshold",
                       "n_train", "n_test", "model_size_kb", "notes")


@query("load_runs", f"""with {fx.RUNS_SQL}
select dataset, method, config, split_policy, seed, f1, fpr, load_order from runs""")
def load_runs(spark, d):
    """Two seed folders of CSVs in different column orders, an empty file beside them, loaded and de-duplicated."""
    keep = ["dataset", "method", "config", "split_policy", "seed", "f1", "fpr", "load_order"]
    raw = fx.runs_raw(spark, d).select(*keep)
    root = shared_path(spark, "runs")
    for n, cols in ((1, keep), (2, keep[::-1])):
        raw.filter(F.col("load_order") == n).select(*cols).write.option("header", True).csv(f"{root}/seed_{n}/a_results.csv")
    raw.limit(0).select(F.lit("").alias("value")).write.text(f"{root}/seed_3/a_results.csv")
    got = tables.load_runs(spark, root, keep, ["f1", "fpr"])
    return got.select(*keep[:-1], F.col("load_order").cast("int").alias("load_order"))


@query("append_jobs", f"""with {fx.RUNS_SQL}
select dataset, method, config, split_policy, seed, f1, fpr from runs where method <> 'base' and seed <= 2""")
def append_jobs(spark, d):
    """Jobs of a sweep write their rows to one table; two of them ran twice, first with other numbers."""
    path = shared_path(spark, "jobs")
    r = materialize(tables.latest_runs(fx.runs_raw(spark, d)))
    stale = r.withColumn("f1", F.lit(0.0))
    for rows, method, seed in ((stale, "extension", 1), (r, "extension", 1), (r, "extension", 2), (r, "proposed", 1),
                               (stale, "proposed", 2), (r, "proposed", 2)):
        tables.append_job(path, rows, {"seed": seed, "method": method})
    return tables.read_jobs(spark, path).select("dataset", "method", "config", "split_policy", "seed", "f1", "fpr")


@query("report_sinks", f"""with {fx.RUNS_SQL}
select 'document' as sink, dataset, method, seed, f1 from runs union all select 'csv', dataset, method, seed, f1 from runs""")
def report_sinks(spark, d):
    """Result documents (JSON) and flat reports (CSV), written and read back."""
    r = materialize(tables.latest_runs(fx.runs_raw(spark, d)).select("dataset", "method", "seed", "f1"))
    docs, flat = shared_path(spark, "documents"), shared_path(spark, "report")
    tables.write_documents(r.select(F.struct("dataset", "method", "seed").alias("run"), F.struct("f1").alias("metrics")), docs)
    tables.write_csv_report(r, flat)
    read = spark.read.schema("run struct<dataset string, method string, seed int>, metrics struct<f1 double>").json(docs)
    csv = spark.read.schema("dataset string, method string, seed int, f1 double").option("header", True).csv(flat)
    return read.select(F.lit("document").alias("sink"), "run.*", "metrics.*").unionByName(csv.withColumn("sink", F.lit("csv")))


@query("upsert_results", f"""with {fx.RUNS_SQL}, fresh as (
  select * replace (round(fpr / 2, 6) as fpr) from runs where seed in (4, 5))
select dataset, config, seed, f1, fpr from runs where seed not in (4, 5)
union all select dataset, config, seed, f1, fpr from fresh""")
def upsert_results(spark, d):
    runs = tables.latest_runs(fx.runs_raw(spark, d))
    fresh = runs.filter(F.col("seed").isin(4, 5)).withColumn("fpr", F.round(F.col("fpr") / 2, 6))
    return tables.upsert(runs, fresh, tables.RUN_KEYS).select("dataset", "config", "seed", "f1", "fpr")


_SIDES = {"click": "train", "error": "train", "purchase": "train", "signup": "val", "view": "test"}


@query("scenario_split", f"""with {fx.EV_SQL}
select case event_type when 'signup' then 'val' when 'view' then 'test' else 'train' end as split,
       count(*) as n_rows, cast(sum(label) as bigint) as n_attack, {r6(frac('sum(label)', 'count(*)'))} as rate
from ev group by 1""")
def scenario_split(spark, d):
    e = splits.assign_scenarios(fx.ev(spark, d), _SIDES, "event_type")
    return e.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_attack"),
        F.round(ratio(F.sum("label"), F.count(F.lit(1))), 6).alias("rate"))
