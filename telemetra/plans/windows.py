"""Window construction and ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import windows
from telemetra.operators.ordering import add_slices, join_null_safe, with_position
from telemetra.plans.registry import query, r6
from telemetra.session import shared_path
from telemetra.sources import fixtures as fx
from telemetra.sources import tables

W = fx.EV_WINDOW


@query("fixed_windows", f"""with {fx.EVW_SQL}
select block, win, count(*) as n, cast(sum(label) as bigint) as n_pos, epoch_us(min(ts)) as start_us,
       epoch_us(max(ts)) as end_us from evw group by all""")
def fixed_windows(spark, d):
    w = windows.window_stats(fx.ev_windows(spark, d), ["block"])
    return w.select("block", "win", "n", "n_pos", fx.micros("start_ts").alias("start_us"),
                    fx.micros("end_ts").alias("end_us"))


@query("complete_windows", f"""with {fx.EVW_SQL}
select block, win, count(*) as n, cast(sum(label) as bigint) as n_pos from evw group by all having count(*) = {W}""")
def complete_windows(spark, d):
    return windows.complete(windows.window_stats(fx.ev_windows(spark, d), ["block"]), W).select(
        "block", "win", "n", "n_pos")


@query("carry_forward_windows", f"""with {fx.EVW_SQL}, v as (
  select block, win, avg(f1) as v from evw group by all having count(*) = {W})
select event_id, {r6('coalesce(a.v, b.v)')} as v from evw
left join v a using (block, win) left join v b on b.block = evw.block and b.win = evw.win - 1""")
def carry_forward_windows(spark, d):
    e = fx.ev_windows(spark, d)
    w = windows.window_stats(e, ["block"], extra={"v": F.avg("f1")})
    v = windows.carry_values(w, ["block"], W, "v")
    return join_null_safe(e, v, ["block", "win"], "left").select("event_id", F.round("v", 6).alias("v"))


@query("sliding_windows", f"""with {fx.EVP_SQL}, s as (
  select block, unnest(range(0, n - {W} + 1, 10)) as start from (select block, count(*) as n from evp group by block))
select s.block, start, max(label) as label_any, arg_max(label, pos) as label_last,
       epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us
from s join evp on evp.block = s.block and pos >= start and pos < start + {W} group by all""")
def sliding_windows(spark, d):
    w = windows.sliding(fx.ev_positions(spark, d), ["block"], W, 10)
    return w.select("block", "start", "label_any", "label_last", fx.micros("start_ts").alias("start_us"),
                    fx.micros("end_ts").alias("end_us"))


def _device_positions(spark, d):
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    return with_position(e, ["user_id"], fx.EV_ORDER).drop("_slice")


_DEV_SQL = f"""{fx.EV_SQL}, dev as (
  select *, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from ev),
s as (select user_id, unnest(range(0, n - 10 + 1, 5)) as start from (select user_id, count(*) as n from dev group by 1)),
j as (select s.user_id, s.start, dev.* exclude (user_id) from s join dev
      on dev.user_id = s.user_id and pos >= start and pos < start + 10)"""


@query("sequence_windows", f"""with {_DEV_SQL}
select user_id, start, max(label) as label_any, arg_max(label, pos) as label_last, epoch_us(max(ts)) as end_us
from j group by all""")
def sequence_windows(spark, d):
    w = windows.sliding(_device_positions(spark, d), ["user_id"], 10, 5)
    return w.select("user_id", "start", "label_any", "label_last", fx.micros("end_ts").alias("end_us"))


@query("sequence_tensor", f"""with {_DEV_SQL}
select user_id, start, count(*) as steps, cast(2 as bigint) as features, arg_min(f1, pos) as first_f1,
       arg_max(f2, pos) as last_f2 from j group by all""")
def sequence_tensor(spark, d):
    """(time, feature) matrices as nested arrays; a window holds ten rows."""
    w = windows.sliding(_device_positions(spark, d), ["user_id"], 10, 5,
                        extra={"x": windows.tensor(["f1", "f2"])})
    return w.select("user_id", "start", F.size("x").cast("long").alias("steps"),
                    F.size(F.col("x")[0]).cast("long").alias("features"), F.col("x")[0][0].alias("first_f1"),
                    F.element_at(F.element_at("x", -1), -1).alias("last_f2"))


@query("window_store", f"""with {fx.EVP_SQL}, s as (
  select block, unnest(range(0, n - {W} + 1, 10)) as start from (select block, count(*) as n from evp group by block))
select case s.block % 5 when 4 then 'test' when 3 then 'val' else 'train' end as split, s.block, start, max(label) as label,
       epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us, cast({W} as bigint) as steps, {r6('sum(f1)', 4)} as total_f1
from s join evp on evp.block = s.block and pos >= start and pos < start + {W} group by all""")
def window_store(spark, d):
    """Window tensors with label and time span, stored by split and read back."""
    w = windows.sliding(fx.ev_positions(spark, d), ["block"], W, 10, extra={"x": windows.tensor(["f1", "f2"])})
    part = F.when(F.col("block") % 5 == 4, "test").when(F.col("block") % 5 == 3, "val").otherwise("train")
    path = shared_path(spark, "windows")
    w = w.withColumn("split", part)
    tables.write_split_store(w, path)
    x = F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0])
    return spark.read.schema(w.schema).parquet(path).select(
        "split", "block", "start", F.col("label_any").alias("label"), fx.micros("start_ts").alias("start_us"),
        fx.micros("end_ts").alias("end_us"), F.size("x").cast("long").alias("steps"), F.round(x, 4).alias("total_f1"))


@query("window_attack_fraction", f"""with {fx.EVW_SQL}
select block, win, {r6('avg(label)')} as attack_fraction, max(label) as label_any, arg_max(label, pos) as label_last,
       case when avg(label) > 0.5 then 1 else 0 end as label_majority from evw group by all having count(*) = {W}""")
def window_attack_fraction(spark, d):
    w = windows.window_stats(fx.ev_windows(spark, d), ["block"],
                             extra={"label_any": F.max("label"), "label_last": F.max_by("label", "pos")})
    frac = F.col("n_pos") / F.col("n")
    return windows.complete(w, W).select(
        "block", "win", F.round(frac, 6).alias("attack_fraction"), "label_any", "label_last",
        F.when(frac > 0.5, 1).otherwise(0).alias("label_majority"))


@query("contiguous_runs", f"""with {fx.EV_SQL}, a as (
  select *, case when lag(event_type) over (order by ts, event_id) is distinct from event_type then 1 else 0 end as new from ev),
b as (select *, cast(sum(new) over (order by ts, event_id) as bigint) as run from a)
select run, event_type, count(*) as n, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us from b group by all""")
def contiguous_runs(spark, d):
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    r = windows.runs(e, "event_type", fx.EV_ORDER)
    return r.select("run", "event_type", "n", fx.micros("start_ts").alias("start_us"),
                    fx.micros("end_ts").alias("end_us"))


_GW_SQL = f"""{fx.EV_SQL}, g as (select *, row_number() over (order by ts, event_id) - 1 as pos from ev),
gw as (select pos // {W} as win, case when avg(label) > 0.5 then 1 else 0 end as y from g group by 1 having count(*) = {W}),
tr as (select *, lag(y) over (order by win) as prev from gw)"""


def majority_windows(spark, d):
    """Complete windows of the whole stream (no blocks) with their majority label."""
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    p = with_position(e, [], fx.EV_ORDER).withColumn("win", F.floor(F.col("pos") / F.lit(W)))
    w = windows.complete(windows.window_stats(p, []), W)
    return w.select("win", F.when(F.col("n_pos") * 2 > F.col("n"), 1).otherwise(0).alias("y"))


def transitions(spark, d):
    w = windows.with_preceding(majority_windows(spark, d), [], {"y": "prev"})
    return w.filter(F.col("prev") != F.col("y"))


@query("label_transitions", f"with {_GW_SQL} select win, prev, y from tr where prev <> y")
def label_transitions(spark, d):
    return transitions(spark, d).select("win", "prev", "y")


@query("global_position", f"""with {fx.EV_SQL}
select event_id, row_number() over (order by ts, event_id) - 1 as pos from ev""")
def global_position(spark, d):
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    return with_position(e, [], fx.EV_ORDER).select("event_id", "pos")
