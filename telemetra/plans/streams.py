"""Streaming queries, each drained over the whole event table and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import online
from telemetra.operators.labels import interval_flag
from telemetra.plans.registry import query, r6
from telemetra.session import prepare, shared_path
from telemetra.sources import fixtures as fx
from telemetra.sources import tables
from telemetra.streaming import streams

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, d):
    s = streams.stream_table(prepare(spark), d, "events.parquet", _SCHEMA)
    ts = F.col("ts").cast("timestamp")
    return s.select("event_id", ts.alias("ts"), "user_id", "event_type", F.col("value").alias("f1"),
                    F.get_json_object("props", "$.k").cast("double").alias("f2"),
                    interval_flag(ts, fx.EVENT_ATTACKS).alias("label"))


#: windows that end at or before the final watermark (latest time minus one hour, in milliseconds)
_MARK = "(select epoch_us(max(ts)) // 1000 * 1000 - 3600000000 from ev)"


@query("stream_block_counts", f"""with {fx.EV_SQL}, w as (
  select epoch_us(time_bucket(interval '20 minutes', ts)) as start_us, count(*) as n, cast(sum(label) as bigint) as n_pos from ev group by 1)
select start_us, n, n_pos, {r6('n_pos / cast(n as double)')} as attack_rate from w where start_us + 1200000000 <= {_MARK}""")
def stream_block_counts(spark, d):
    out = streams.drain(streams.window_counts(events(spark, d), "1 hour", "20 minutes"), "blocks")
    return out.select(fx.micros("start_ts").alias("start_us"), "n", "n_pos",
                      F.round(F.col("n_pos") / F.col("n"), 6).alias("attack_rate"))


@query("stream_sliding_label", f"""with {fx.EV_SQL}, w as (
  select s.start_us, count(*) as n, max(label) as label_any from (
    select label, unnest([epoch_us(ts) // 30000000 * 30000000, epoch_us(ts) // 30000000 * 30000000 - 30000000]) as start_us from ev) s group by 1)
select * from w where start_us + 60000000 <= {_MARK}""")
def stream_sliding_label(spark, d):
    out = streams.drain(streams.window_counts(events(spark, d), "1 hour", "60 seconds", "30 seconds"), "sliding")
    return out.select(fx.micros("start_ts").alias("start_us"), "n", "label_any")


@query("stream_sessions", f"""with {fx.EV_SQL}, a as (
  select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 7200000000 then 0 else 1 end as new from ev),
b as (select *, sum(new) over (partition by user_id order by ts) as k from a),
s as (select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 7200000000 as end_us, count(*) as n from b group by user_id, k)
select * from s where end_us <= {_MARK}""")
def stream_sessions(spark, d):
    out = streams.drain(streams.sessions(events(spark, d), "user_id", "2 hours", "1 hour"), "sessions")
    return out.select("user_id", fx.micros("start_ts").alias("start_us"), fx.micros("end_ts").alias("end_us"), "n")


@query("stream_interval_label", f"with {fx.EV_SQL} select event_id, label from ev")
def stream_interval_label(spark, d):
    return streams.drain(events(spark, d).select("event_id", "label"), "labels")


_SW = f"""sw as (select event_type, epoch_us(time_bucket(interval '2 hours', ts)) as start_us, count(*) as n, sum(label) as n_pos, avg(f1) as score,
    case when count(*) >= 2 and stddev_samp(f1) > 1e-12 and stddev_samp(f2) > 1e-12
         then covar_samp(f1, f2) / (stddev_samp(f1) * stddev_samp(f2)) else 0.0 end as r from ev group by 1, 2),
so as (select *, row_number() over (partition by event_type order by start_us) - 1 as ord from sw where start_us + 7200000000 <= {_MARK})"""


def _score_columns():
    """Mean value and correlation of a two-hour window."""
    sf, sg = F.stddev_samp("f1"), F.stddev_samp("f2")
    r = F.when((F.count(F.lit(1)) >= 2) & (sf > 1e-12) & (sg > 1e-12), F.covar_samp("f1", "f2") / (sf * sg)).otherwise(0.0)
    return {"score": F.avg("f1"), "r1": r}


def _windows(df):
    return streams.window_counts(df, "1 hour", "2 hours", keys=["event_type"], extra=_score_columns())


def _closed(spark, d):
    """First query: closed windows appended to a table.  Returns it as a table and as a stream."""
    w = _windows(events(spark, d))
    path = streams.drain_to(w, "scores")
    return spark.read.schema(w.schema).parquet(path), streams.follow(spark, path, w.schema)


@query("stream_cusum", f"""with recursive {fx.EV_SQL}, {_SW},
cal as (select avg(score) as m, stddev_samp(score) as s from so where n_pos = 0),
zs as (select so.*, (score - m) / s as z from so, cal),
fold(event_type, ord, start_us, z, cusum, alarm) as (
  select event_type, ord, start_us, z, case when greatest(0.0, z - 0.5) >= 5.0 then 0.0 else greatest(0.0, z - 0.5) end,
         case when greatest(0.0, z - 0.5) >= 5.0 then 1 else 0 end from zs where ord = 0
  union all select zs.event_type, zs.ord, zs.start_us, zs.z,
         case when greatest(0.0, f.cusum + zs.z - 0.5) >= 5.0 then 0.0 else greatest(0.0, f.cusum + zs.z - 0.5) end,
         case when greatest(0.0, f.cusum + zs.z - 0.5) >= 5.0 then 1 else 0 end
  from fold f join zs on zs.event_type = f.event_type and zs.ord = f.ord + 1)
select event_type, start_us, {r6('z')} as z, {r6('cusum')} as cusum, alarm from fold""")
def stream_cusum(spark, d):
    table, stream = _closed(spark, d)
    det = online.calibrate(table.filter("n_pos = 0"), "score", allow_empty=True)
    out = streams.drain(streams.cusum(stream, "event_type", "start_ts", "score", det), "cusum")
    return out.select("event_type", fx.micros("start_ts").alias("start_us"), (F.round("z", 6) + 0.0).alias("z"),
                      F.round("cusum", 6).alias("cusum"), "alarm")


@query("stream_gated_adaptation", f"""with recursive {fx.EV_SQL}, {_SW},
b0 as (select corr(f1, f2) as r from ev where label = 0),
cal as (select avg(v) as m, stddev_samp(v) as s from (select sqrt(2 * pow(so.r - b0.r, 2)) as v from so, b0 where n_pos = 0 and n >= 2)),
fold as (select event_type, cast(-1 as bigint) as ord, cast(0 as bigint) as start_us, cast(0.0 as double) as div, cast(0.0 as double) as cusum,
                0 as alarm, 0 as updated, b0.r as r from b0, (select distinct event_type from so)
  union all select event_type, ord, start_us, div, case when s1 >= 5.0 then 0.0 else s1 end, case when s1 >= 5.0 then 1 else 0 end,
         case when s1 < 5.0 and ok then 1 else 0 end, case when s1 < 5.0 and ok then 0.05 * nr + 0.95 * orr else orr end
  from (select so.event_type, so.ord, so.start_us, so.n >= 2 and (so.n - so.n_pos) / cast(so.n as double) >= 0.9 as ok,
               case when so.n >= 2 then sqrt(2 * pow(so.r - f.r, 2)) else 0.0 end as div,
               greatest(0.0, f.cusum + (case when so.n >= 2 then sqrt(2 * pow(so.r - f.r, 2)) else 0.0 end - m) / s - 0.5) as s1,
               so.r as nr, f.r as orr
        from fold f join so on so.event_type = f.event_type and so.ord = f.ord + 1, cal))
select event_type, start_us, {r6('div')} as divergence, {r6('cusum')} as cusum, alarm, updated from fold where ord >= 0""")
def stream_gated_adaptation(spark, d):
    e = fx.ev(spark, d).filter("label = 0")
    start = e.agg((F.covar_samp("f1", "f2") / (F.stddev_samp("f1") * F.stddev_samp("f2"))).alias("r")).first()["r"]
    v = F.sqrt(2 * F.pow(F.col("r1") - F.lit(start), 2))
    table, stream = _closed(spark, d)
    det = online.calibrate(table.filter("n_pos = 0 and n >= 2").select(v.alias("v")), "v", allow_empty=True)
    w = stream.select("event_type", "start_ts", F.array("r1").alias("r"),
                 ((F.col("n") - F.col("n_pos")) / F.col("n")).alias("benign_fraction"), "n")
    out = streams.drain(streams.gated(w, "event_type", "start_ts", [start], det, 0.05, 0.9), "gated")
    return out.select("event_type", fx.micros("start_ts").alias("start_us"), F.round("divergence", 6).alias("divergence"),
                      F.round("cusum", 6).alias("cusum"), "alarm", "updated")


@query("stream_dedupe_runs", f"with {fx.RUNS_SQL} select dataset, method, config, seed, f1, load_order from runs")
def stream_dedupe_runs(spark, d):
    path = shared_path(prepare(spark), "runs")
    fx.runs_raw(spark, d).write.parquet(path)
    raw = spark.read.parquet(path)
    s = streams.stream_table(spark, path, "*.parquet", raw.schema, files_per_batch=2)
    return streams.latest_by_batch(s, tables.RUN_KEYS, "load_order", "latest").select(
        "dataset", "method", "config", "seed", "f1", "load_order")
