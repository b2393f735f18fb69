"""Class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import balance, windows
from telemetra.plans.registry import query, r6
from telemetra.session import materialize
from telemetra.sources import fixtures as fx


def _labels(spark, d):
    return fx.ev(spark, d).select("event_id", "label")


_CNT = "c as (select sum(label) as n1, count(*) - sum(label) as n0 from ev)"
_MIN = "case when n0 >= n1 then 1 else 0 end"


@query("undersample", f"""with {fx.EV_SQL}, {_CNT},
r as (select event_id, label, row_number() over (partition by label order by md5('42|' || event_id)) as rk from ev)
select event_id, label from r, c where label = {_MIN} or rk <= least(greatest(n0, n1), round_even(least(n0, n1) * 2.0, 0))""")
def undersample(spark, d):
    return balance.undersample(_labels(spark, d), 2.0, F.col("event_id"), 42)


@query("oversample", f"""with {fx.EV_SQL}, {_CNT},
r as (select event_id, label, row_number() over (partition by label order by md5('42|' || event_id)) - 1 as rk from ev),
t as (select event_id, label, case when label = {_MIN} then greatest(n0, n1) // least(n0, n1)
        + case when rk < greatest(n0, n1) % least(n0, n1) then 1 else 0 end else 1 end as times from r, c)
select event_id, label, unnest(range(0, cast(times as bigint))) as copy from t""")
def oversample(spark, d):
    return balance.oversample(_labels(spark, d), F.col("event_id"), 42).withColumn("copy", F.col("copy").cast("long"))


@query("class_weights", f"""with {fx.EV_SQL}
select label, count(*) as n, {r6('(select count(*) from ev) / (2.0 * count(*))')} as weight from ev group by label""")
def class_weights(spark, d):
    return balance.class_weights(_labels(spark, d)).withColumn("weight", F.round("weight", 6))


@query("pos_weight", f"""with {fx.EV_SQL}
select {r6('case when sum(label) > 0 then (count(*) - sum(label)) / cast(sum(label) as double) else 1.0 end')} as pos_weight from ev""")
def pos_weight(spark, d):
    return balance.pos_weight(_labels(spark, d)).withColumn("pos_weight", F.round("pos_weight", 6))


@query("window_undersample", f"""with {fx.EVW_SQL}, w as (
  select block, win, max(label) as label from evw group by all having count(*) = {fx.EV_WINDOW}),
c as (select sum(label) as n1, count(*) - sum(label) as n0 from w),
r as (select *, row_number() over (partition by label order by md5('42|' || block || '|' || win)) as rk from w)
select block, win, label from r, c where label = {_MIN} or rk <= least(n0, n1)""")
def window_undersample(spark, d):
    """Whole windows are dropped, never rows of a window."""
    w = windows.window_stats(fx.ev_windows(spark, d), ["block"], extra={"y": F.max("label")})
    w = materialize(windows.complete(w, fx.EV_WINDOW).select("block", "win", F.col("y").alias("label")))
    return balance.undersample(w, 1.0, F.concat_ws("|", "block", "win"), 42)
