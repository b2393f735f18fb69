"""Blocks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import splits, windows
from telemetra.operators.ordering import add_slices, with_position
from telemetra.plans.registry import query, r6
from telemetra.session import materialize, shared_path
from telemetra.sources import fixtures as fx
from telemetra.sources import tables

_POLICY = splits.PROJECT_STANDARD

_DEAL_SQL = f"""{fx.EVB_SQL}, bs as (
  select block, count(*) as n_rows, cast(sum(label) as bigint) as n_pos,
         case when sum(label) = 0 then 0 when sum(label) = count(*) then 2 else 1 end as stratum
  from evb group by block),
bd as (select *, row_number() over (partition by stratum order by md5('42|' || block)) - 1 as rk,
              count(*) over (partition by stratum) as n from bs),
bt as (select *, case when n >= 3 then least(greatest(1, cast(round_even(n * cast(0.2 as double), 0) as bigint)), n - 2)
                      when n = 2 then 1 else 0 end as t from bd),
bv as (select *, case when n >= 3 then least(greatest(1, cast(round_even(n * cast(0.1 as double), 0) as bigint)), n - t - 1)
                      else 0 end as v from bt),
deal as (select block, n_rows, n_pos, stratum,
                case when rk < t then 'test' when rk < t + v then 'val' else 'train' end as split from bv)"""


def dealt(spark, d):
    return splits.deal_blocks(fx.ev_blocks(spark, d), _POLICY)


@query("time_blocks", f"""with {fx.EVB_SQL}
select block, count(*) as n_rows, cast(sum(label) as bigint) as n_attack from evb group by block""")
def time_blocks(spark, d):
    return fx.ev_blocks(spark, d).groupBy("block").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_attack"))


_SCB_SQL = f"""{fx.EV_SQL}, scb as (
  select *, event_type || '#' || ((row_number() over (partition by event_type order by ts, event_id) - 1) // 50) as block
  from ev)"""


def scenario_blocks(spark, d):
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    p = with_position(e, ["event_type"], fx.EV_ORDER).drop("_slice")
    return p.withColumn("block", F.concat_ws("#", "event_type", F.floor(F.col("pos") / 50).cast("string")))


@query("position_blocks", f"with {_SCB_SQL} select event_id, block from scb")
def position_blocks(spark, d):
    return scenario_blocks(spark, d).select("event_id", "block")


@query("block_split", f"with {_DEAL_SQL} select block, n_rows, n_pos, stratum, split from deal")
def block_split(spark, d):
    return dealt(spark, d)


@query("scenario_block_split", f"""with {_SCB_SQL}, bs as (
  select event_type, block, count(*) as n_rows, cast(sum(label) as bigint) as n_pos,
         case when sum(label) * 2 >= count(*) then 1 else 0 end as attacked from scb group by all),
bd as (select *, row_number() over (partition by event_type, attacked order by md5('42|' || block)) - 1 as rk,
              count(*) over (partition by event_type, attacked) as n from bs),
bt as (select *, case when n >= 3 then least(greatest(1, cast(round_even(n * cast(0.6 as double), 0) as bigint)), n - 2)
                      else 1 end as t from bd),
bv as (select *, case when n >= 3 then least(greatest(1, cast(round_even(n * cast(0.15 as double), 0) as bigint)), n - t - 1)
                      else 0 end as v from bt)
select event_type, block, n_rows, n_pos, attacked,
       case when rk < t then 'train' when rk < t + v then 'val' else 'test' end as split from bv""")
def scenario_block_split(spark, d):
    return splits.deal_scenario_blocks(scenario_blocks(spark, d), 42, "event_type")


@query("split_rows", f"""with {_DEAL_SQL}
select event_id, evb.block, label, split from evb join deal using (block)""")
def split_rows(spark, d):
    """Rows stored by split; each split is read back through partition pruning."""
    path = shared_path(spark, "rows")
    rows = splits.attach(fx.ev_blocks(spark, d), dealt(spark, d), ["block"])
    rows = rows.select("event_id", "block", "label", "split")
    tables.write_split_store(rows, path)
    parts = [tables.read_split(spark, path, s, rows.schema) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("frozen_split_roundtrip", f"""with {_DEAL_SQL}
select split, 'block' as strategy, count(*) as n_rows, cast(sum(label) as bigint) as n_attack,
       count(distinct evb.block) as n_blocks from evb join deal using (block) group by split""")
def frozen_split_roundtrip(spark, d):
    path = shared_path(spark, "split")
    tables.save_assignment(dealt(spark, d).select("block", "split"), _POLICY.as_dict(), path)
    stored, config = tables.load_assignment(spark, path)
    rows = splits.attach(fx.ev_blocks(spark, d), stored, ["block"])
    per = rows.groupBy("split", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    return per.groupBy("split").agg(F.sum("n").alias("n_rows"), F.sum("y").cast("long").alias("n_attack"),
                                    F.count(F.lit(1)).alias("n_blocks")) \
        .withColumn("strategy", F.lit(config["strategy"]))


@query("split_matches_frozen", f"""with {_DEAL_SQL}
select count(*) as n_blocks, cast(0 as bigint) as n_differ from deal""")
def split_matches_frozen(spark, d):
    path = shared_path(spark, "split")
    tables.save_assignment(dealt(spark, d).select("block", "split"), _POLICY.as_dict(), path)
    stored, _ = tables.load_assignment(spark, path)
    rebuilt = dealt(spark, d).select("block", "split")
    bad = tables.mismatches(rebuilt, stored).count()
    return stored.agg(F.count(F.lit(1)).alias("n_blocks")).withColumn("n_differ", F.lit(bad))


@query("split_summary", f"""with {_DEAL_SQL}
select coalesce(split, 'total') as split, count(*) as n_rows, cast(sum(label) as bigint) as n_attack,
       {r6('sum(label) / cast(count(*) as double)')} as rate, count(distinct evb.block) as n_blocks
from evb join deal using (block) group by rollup(split)""")
def split_summary(spark, d):
    """Totals come from the block table: one row per block, not per data row."""
    b = dealt(spark, d)
    return (b.rollup("split").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_attack"),
                                  F.count(F.lit(1)).alias("n_blocks"))
            .withColumn("rate", F.round(F.col("n_attack") / F.col("n_rows"), 6))
            .withColumn("split", F.coalesce("split", F.lit("total"))))


@query("split_disjoint", f"""with {_DEAL_SQL}
select count(*) as n_rows, count(*) filter (block % 11 = 5) as unassigned,
       count(distinct block) filter (block % 13 = 4 and block % 11 <> 5) as overlapping from evb""")
def split_disjoint(spark, d):
    """An assignment in which some blocks are missing and some stand in two splits."""
    rows = fx.ev_blocks(spark, d)
    a = dealt(spark, d).select("block", "split").filter("block % 11 <> 5")
    a = a.unionByName(a.filter("block % 13 = 4").withColumn("split", F.lit("other")))
    lost = rows.join(a, "block", "left_anti").count()
    over = splits.overlap(a, "block").count()
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"unassigned": F.lit(lost), "overlapping": F.lit(over)})


@query("random_stratified_split", f"""with {fx.EV_SQL}, r as (
  select event_id, label, row_number() over (partition by label order by md5('42|' || event_id)) - 1 as rk,
         count(*) over (partition by label) as n from ev)
select event_id, label, case when rk < round_even(n * cast(0.2 as double), 0) then 'test'
  when rk < round_even(n * cast(0.2 as double), 0) + round_even(n * cast(0.1 as double), 0) then 'val' else 'train' end as split from r""")
def random_stratified_split(spark, d):
    e = fx.ev(spark, d).select("event_id", "label")
    return splits.split_random(e, splits.BASE_REFERENCE, F.col("event_id")).select("event_id", "label", "split")


_TEMPORAL = splits.SplitPolicy("temporal", 0.2, 0.1)


@query("temporal_split", f"""with {fx.EV_SQL}, r as (
  select event_id, row_number() over (order by ts, event_id) - 1 as g, count(*) over () as n from ev),
c as (select *, round_even(n * cast(1 - 0.2 as double), 0) as fit from r)
select event_id, case when g < round_even(fit * (1 - cast(0.1 as double) / (1 - cast(0.2 as double))), 0) then 'train'
                      when g < fit then 'val' else 'test' end as split from c""")
def temporal_split(spark, d):
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    return splits.split_temporal(e, _TEMPORAL, fx.EV_ORDER).select("event_id", "split")


@query("group_split", f"""with {fx.EV_SQL}, u as (
  select user_id, row_number() over (order by md5('42|' || user_id)) - 1 as rk, count(*) over () as n
  from (select distinct user_id from ev)),
c as (select *, ceil(n * cast(0.2 as double)) as t from u),
s as (select user_id, case when rk < t then 'test'
        when rk < t + ceil((n - t) * (cast(0.1 as double) / (1 - cast(0.2 as double)))) then 'val' else 'train' end as split from c)
select split, count(*) as n_rows, count(distinct user_id) as n_users, cast(sum(label) as bigint) as n_attack
from ev join s using (user_id) group by split""")
def group_split(spark, d):
    e = fx.ev(spark, d)
    per = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    a = splits.deal_groups(e, splits.SplitPolicy("group", 0.2, 0.1), "user_id")
    return splits.attach(per, a, ["user_id"]).groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"), F.sum("y").cast("long").alias("n_attack"))


@query("window_split", f"""with {fx.EVW_SQL}, w as (
  select block, win, max(ts) as end_ts, max(label) as y from evw group by all having count(*) = 20),
t as (select *, row_number() over (order by end_ts, block, win) - 1 as g, count(*) over () as n,
             row_number() over (partition by y order by md5('42|' || block || '|' || win)) - 1 as rk,
             count(*) over (partition by y) as nc from w),
c as (select *, round_even(n * cast(1 - 0.2 as double), 0) as fit from t)
select block, win, y, case when g < round_even(fit * (1 - cast(0.1 as double) / (1 - cast(0.2 as double))), 0) then 'train'
                           when g < fit then 'val' else 'test' end as split_temporal,
       case when rk < round_even(nc * cast(0.2 as double), 0) then 'test'
            when rk < round_even(nc * cast(0.2 as double), 0) + round_even(nc * cast(0.1 as double), 0) then 'val' else 'train' end as split_random
from c""")
def window_split(spark, d):
    """Windows, not rows, are divided, so that none straddles two sides."""
    w = windows.complete(windows.window_stats(fx.ev_windows(spark, d), ["block"],
                                              extra={"y": F.max("label")}), fx.EV_WINDOW)
    w = materialize(w.select("block", "win", "y", F.col("end_ts").alias("ts")))
    rnd = splits.split_random(w, splits.BASE_REFERENCE, F.concat_ws("|", "block", "win"), "y") \
        .withColumnRenamed("split", "split_random")
    sliced = add_slices(rnd, fx.micros())
    return splits.split_temporal(sliced, _TEMPORAL, ["ts", "block", "win"]).select(
        "block", "win", "y", F.col("split").alias("split_temporal"), "split_random")


@query("window_group_split", f"""with {fx.EV_SQL}, p as (
  select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 4 as win from ev),
w as (select user_id, win, max(label) as y from p group by all having count(*) = 4),
u as (select user_id, row_number() over (order by md5('42|' || user_id)) - 1 as rk, count(*) over () as n from (select distinct user_id from w)),
c as (select *, ceil(n * cast(0.2 as double)) as t from u),
s as (select user_id, case when rk < t then 'test'
        when rk < t + ceil((n - t) * (cast(0.1 as double) / (1 - cast(0.2 as double)))) then 'val' else 'train' end as split from c)
select user_id, win, y, split from w join s using (user_id)""")
def window_group_split(spark, d):
    """Windows of four events of a device, divided by device."""
    e = add_slices(fx.ev(spark, d).withColumn("ts_us", fx.micros()), F.col("ts_us"), F.col("event_id"))
    w = (with_position(e, ["user_id"], ["ts_us", "event_id"]).withColumn("win", F.expr("pos div 4"))
         .groupBy("user_id", "win").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("y")).filter("n = 4"))
    return splits.resplit_windows(materialize(w), splits.SplitPolicy("group", 0.2, 0.1), "group", key=F.col("win"), group="user_id").select(
        "user_id", "win", "y", "split")
