"""Labels, class balance, entity and distribution summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import eda, labels, splits
from telemetra.plans.registry import frac, query, r6
from telemetra.sources import fixtures as fx


@query("interval_label", """select event_id, case when """ + fx._hits("ts", fx.EVENT_ATTACKS) + """ then 1 else 0 end as label
from events""")
def interval_label(spark, d):
    """Range join against a table of intervals (day buckets, merged pieces)."""
    wins = spark.createDataFrame(fx.EVENT_ATTACKS, "name string, start_ts string, end_ts string").select(
        F.col("start_ts").cast("timestamp").alias("start_ts"), F.col("end_ts").cast("timestamp").alias("end_ts"))
    e = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return labels.label_by_intervals(e, "ts", wins).select("event_id", "label")


@query("interval_match_counts", " union all ".join(
    f"select '{n}' as name, count(*) as matched from events where ts between timestamp '{a}' and timestamp '{b}'"
    for n, a, b in fx.EVENT_ATTACKS))
def interval_match_counts(spark, d):
    e = fx.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return labels.interval_matches(e, F.col("ts"), fx.EVENT_ATTACKS)


@query("class_balance", f"""with {fx.EV_SQL}
select label, count(*) as n, {r6('count(*) * 100.0 / (select count(*) from ev)')} as pct from ev group by label""")
def class_balance(spark, d):
    return eda.class_balance(fx.ev(spark, d), "label").withColumn("pct", F.round("pct", 6))


@query("attack_rate_by_day", f"""with {fx.EV_SQL}
select strftime(ts, '%Y-%m-%d') as day, count(*) as n, {r6('avg(label)')} as rate from ev group by 1""")
def attack_rate_by_day(spark, d):
    return fx.ev(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("rate"))


@query("entity_counts", f"""with {fx.EV_SQL}
select user_id, count(*) as n, (select count(distinct user_id) from ev) as n_entities from ev group by user_id""")
def entity_counts(spark, d):
    n = fx.ev(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("n_entities", F.lit(n.count()))


@query("entity_codes", f"""with {fx.EV_SQL}
select user_id, dense_rank() over (order by user_id) - 1 as code from (select distinct user_id from ev)""")
def entity_codes(spark, d):
    return eda.entity_codes(fx.ev(spark, d), "user_id")


@query("entity_means", f"""with {fx.EV_SQL}
select user_id, {r6('avg(f1)')} as mean_f1, {r6('avg(f2)')} as mean_f2 from ev group by user_id order by 2 desc, 1""")
def entity_means(spark, d):
    return fx.ev(spark, d).groupBy("user_id").agg(
        F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.avg("f2"), 6).alias("mean_f2")) \
        .orderBy(F.desc("mean_f1"), "user_id")


@query("describe_numeric", f"with {fx.LI_SQL} " + " union all ".join(
    f"""select '{c}' as feature, count({c}) as n, {r6(f'avg({c})', 4)} as mean, {r6(f'stddev_samp({c})', 4)} as std,
{r6(f'min({c})')} as min, {r6(f'quantile_cont({c}, 0.25)')} as q25, {r6(f'quantile_cont({c}, 0.5)')} as q50,
{r6(f'quantile_cont({c}, 0.75)')} as q75, {r6(f'max({c})')} as max from li""" for c in ("f1", "f2", "f3", "f4")))
def describe_numeric(spark, d):
    out = eda.describe(fx.li(spark, d), ["f1", "f2", "f3", "f4"])
    return out.select("feature", "n", *[F.round(c, k).alias(c) for c, k in
                                        (("mean", 4), ("std", 4), ("min", 6), ("q25", 6), ("q50", 6),
                                         ("q75", 6), ("max", 6))])


@query("time_range", "select epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from events")
def time_range(spark, d):
    return fx.ev(spark, d).agg(F.min(fx.micros()).alias("first_us"), F.max(fx.micros()).alias("last_us"))


@query("histogram", """with b as (select min(value) as lo, max(value) as hi from events)
select cast(least(floor((value - lo) / ((hi - lo) / 100)), 99) as integer) as bin, count(*) as n from events, b group by 1""")
def histogram(spark, d):
    return eda.histogram(fx.ev(spark, d), "f1", 100)


@query("boxplot_stats", f"""with q as (
  select user_id, count(*) as n, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as b,
         quantile_cont(value, 0.75) as c from events group by 1)
select user_id, n, {r6('a')} as q25, {r6('b')} as q50, {r6('c')} as q75,
  (select count(*) from events e where e.user_id = q.user_id and (value < a - 1.5 * (c - a) or value > c + 1.5 * (c - a))) as n_outliers
from q""")
def boxplot_stats(spark, d):
    b = eda.boxplot(fx.ev(spark, d), "user_id", "f1")
    return b.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")],
                    F.col("n_outliers").cast("long").alias("n_outliers"))


@query("entity_timeseries", f"""with {fx.EV_SQL}
select user_id, epoch_us(time_bucket(interval '1 day', ts)) as day_us, count(*) as n, {r6('avg(f1)')} as mean_f1
from ev group by all""")
def entity_timeseries(spark, d):
    return fx.ev(spark, d).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1")).select(
        "user_id", fx.micros("w.start").alias("day_us"), "n", "mean_f1")


@query("block_attack_rate", f"""with {fx.EVB_SQL}
select block, {r6(frac('sum(label)', 'count(*)'))} as rate,
       case when sum(label) = 0 then 0 when sum(label) = count(*) then 2 else 1 end as stratum from evb group by block""")
def block_attack_rate(spark, d):
    s = splits.block_stats(fx.ev_blocks(spark, d), ["block"])
    return s.select("block", F.round(F.col("n_pos") / F.col("n_rows"), 6).alias("rate"),
                    splits.stratum(F.col("n_rows"), F.col("n_pos")).alias("stratum"))
