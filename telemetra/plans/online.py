"""Change detection and adaptive baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators import correlation as co
from telemetra.operators import online, windows
from telemetra.operators.ordering import add_slices, join_null_safe, with_position
from telemetra.plans.graph import KEYS, corr_sql, frob_sql
from telemetra.plans.registry import query, r6
from telemetra.session import materialize
from telemetra.sources import fixtures as fx

FEATS = ["f1", "f2", "f3", "f4"]
PAIRS = [co.pair_name(a, b) for a, b in co.pairs(FEATS)]
ALPHA, TRACK = 0.05, 0.1

# --- CUSUM over the mean value of event windows -------------------------------


def event_scores(spark, d):
    """Complete event windows in stream order with their mean value as score."""
    w = windows.window_stats(fx.ev_windows(spark, d), ["block"], extra={"score": F.avg("f1")})
    return windows.with_ordinal(materialize(windows.complete(w, fx.EV_WINDOW)), "block")


_ES_SQL = f"""{fx.EVW_SQL}, es as (
  select block, win, count(*) as n, sum(label) as n_pos, avg(f1) as score from evw group by block, win
  having count(*) = {fx.EV_WINDOW}),
es2 as (select *, row_number() over (order by block, win) - 1 as ord from es),
cal as (select avg(score) as m, case when coalesce(stddev_samp(score), 0) < 1e-12 then 1.0 else stddev_samp(score) end as s,
               count(*) as n_benign from es where n_pos = 0)"""

_CUSUM_SQL = f"""with recursive {_ES_SQL}, zs as (select ord, block, win, (score - m) / s as z from es2, cal),
fold(ord, block, win, z, cusum, alarm) as (
  select ord, block, win, z, case when greatest(0.0, z - 0.5) >= 5.0 then 0.0 else greatest(0.0, z - 0.5) end,
         case when greatest(0.0, z - 0.5) >= 5.0 then 1 else 0 end from zs where ord = 0
  union all
  select zs.ord, zs.block, zs.win, zs.z,
         case when greatest(0.0, fold.cusum + zs.z - 0.5) >= 5.0 then 0.0 else greatest(0.0, fold.cusum + zs.z - 0.5) end,
         case when greatest(0.0, fold.cusum + zs.z - 0.5) >= 5.0 then 1 else 0 end
  from fold join zs on zs.ord = fold.ord + 1)"""


@query("cusum_calibration", f"""with {_ES_SQL} select {r6('m')} as mean, {r6('s')} as std, n_benign from cal""")
def cusum_calibration(spark, d):
    """Mean and deviation of the benign scores (one aggregate over windows)."""
    s = F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    return event_scores(spark, d).filter("n_pos = 0").agg(
        F.round(F.avg("score"), 6).alias("mean"), F.round(F.when(s < 1e-12, 1.0).otherwise(s), 6).alias("std"),
        F.count(F.lit(1)).alias("n_benign"))


def _cusum(spark, d):
    s = event_scores(spark, d)
    det = online.calibrate(s.filter("n_pos = 0"), "score", allow_empty=True)
    return s, online.cusum_alarms(s, [], "ord", "score", det)


@query("cusum_alarms", f"{_CUSUM_SQL} select ord, {r6('z')} as z, {r6('cusum')} as cusum, alarm from fold")
def cusum_alarms(spark, d):
    _, a = _cusum(spark, d)
    return a.select("ord", (F.round("z", 6) + 0.0).alias("z"), F.round("cusum", 6).alias("cusum"), "alarm")


@query("first_benign_window", f"""with {fx.EVW_SQL}
select block, win, count(*) as n, cast(sum(label) as bigint) as n_pos from evw group by block, win
having count(*) >= 2 and avg(1 - label) >= 0.9 order by block, win limit 1""")
def first_benign_window(spark, d):
    w = windows.window_stats(fx.ev_windows(spark, d), ["block"]).select("block", "win", "n", "n_pos")
    return online.first_benign(w, ["block", "win"])


# --- change detection on the shipment stream (flagship) ------------------------

_FIVE = fx.LI_FEATURES


@query("change_detection", f"""with recursive {fx.LIW_SQL},
base as (select {corr_sql(_FIVE)} from lib where attack = 0 and split = 'train'),
wc as (select stream, block, win, count(*) as n, sum(attack) as n_pos, min(ts) as start_ts, max(ts) as end_ts, max(split) as split,
       {corr_sql(_FIVE)} from liw group by stream, block, win),
wd as (select wc.*, case when n < 2 then 0.0 else {frob_sql(_FIVE)} end as div, row_number() over (partition by stream order by block, win) - 1 as ord from wc, base),
cal as (select avg(div) as m, stddev_samp(div) as s from wd where n_pos = 0 and split = 'train' and n >= 2),
zs as (select wd.*, (div - m) / s as z from wd, cal),
fold(stream, ord, cusum, alarm) as (
  select stream, ord, case when greatest(0.0, z - 0.5) >= 5.0 then 0.0 else greatest(0.0, z - 0.5) end,
         case when greatest(0.0, z - 0.5) >= 5.0 then 1 else 0 end from zs where ord = 0
  union all
  select zs.stream, zs.ord, case when greatest(0.0, f.cusum + zs.z - 0.5) >= 5.0 then 0.0 else greatest(0.0, f.cusum + zs.z - 0.5) end,
         case when greatest(0.0, f.cusum + zs.z - 0.5) >= 5.0 then 1 else 0 end
  from fold f join zs on zs.stream = f.stream and zs.ord = f.ord + 1)
select stream, block, win, n, epoch_us(start_ts) as start_us, epoch_us(end_ts) as end_us,
       {r6('n_pos / cast(n as double)')} as attack_fraction, {r6('div')} as divergence, {r6('z')} as z, alarm
from zs join fold using (stream, ord)""")
def change_detection(spark, d):
    """Which windows left normal behaviour, and when did the detector fire?"""
    x = fx.li_blocks(spark, d)
    base = co.baseline(x.filter((F.col("attack") == 0) & (F.col("split") == "train")), _FIVE)
    w = co.window_scores(fx.li_windows(spark, d), KEYS, _FIVE, base, extra={
        "n_pos": F.sum("attack").cast("long"), "start_us": fx.micros_agg(F.min), "end_us": fx.micros_agg(F.max),
        # a number, not text: text buffers would turn hash aggregation into a sort
        "is_train": F.max(F.when(F.col("split") == "train", 1).otherwise(0))})
    # the window table (rows / window size) feeds numbering, calibration, fold and report
    # a block's remainder is a window too; one row alone has no correlation and scores 0
    w = materialize(w.select(*KEYS, "win", "n", "n_pos", "start_us", "end_us", "is_train",
                             F.coalesce("divergence", F.lit(0.0)).alias("divergence")))
    w = windows.with_ordinal(w, "block", ["stream"])
    fit = w.filter((F.col("n_pos") == 0) & (F.col("is_train") == 1) & (F.col("n") >= 2))
    det = online.calibrate(fit, "divergence", allow_empty=True)
    a = online.cusum_alarms(w, ["stream"], "ord", "divergence", det)
    return join_null_safe(w, a, ["stream", "ord"]).select(
        *KEYS, "win", "n", "start_us", "end_us", F.round(F.col("n_pos") / F.col("n"), 6).alias("attack_fraction"),
        F.round("divergence", 6).alias("divergence"), (F.round("z", 6) + 0.0).alias("z"), "alarm")


# --- adaptive baselines --------------------------------------------------------


_WM = f"""wm as (select stream, block, win, count(*) as n, avg(1 - attack) as benign, max(split) as split, {corr_sql(FEATS)}
  from liw group by stream, block, win),
wo as (select *, row_number() over (partition by stream order by block, win) - 1 as ord from wm)"""


def ship_matrices(spark, d):
    """Shipment windows per stream, remainders too: order number, triangle, benign share.  Stored once."""
    w = co.correlations(fx.li_windows(spark, d), [*KEYS, "win"], FEATS, extra={
        "benign_fraction": F.avg(1 - F.col("attack")),
        "is_train": F.max(F.when(F.col("split") == "train", 1).otherwise(0))})
    w = materialize(w.select(*KEYS, "win", "n", "benign_fraction", "is_train", F.array(*PAIRS).alias("r")))
    return windows.with_ordinal(w, "block", ["stream"])


def _upd(a: float, old: str, new: str) -> str:
    return ", ".join(f"{a} * {new}.{p} + {1 - a} * {old}.{p} as {p}" for p in PAIRS)


def _dist(a: str, b: str) -> str:
    return "sqrt(2 * (" + " + ".join(f"pow({a}.{p} - {b}.{p}, 2)" for p in PAIRS) + "))"


def _dist2(a: str, b: str) -> str:
    return f"case when {a}.n < 2 then 0.0 else {_dist(a, b)} end"


def _upd2(a: float, old: str, new: str) -> str:
    return ", ".join(f"case when {new}.n < 2 then {old}.{p} else {a} * {new}.{p} + {1 - a} * {old}.{p} end as {p}" for p in PAIRS)


_EWMA_SQL = f"""with recursive {fx.LIW_SQL}, {_WM},
fold as (select stream, ord, cast(0.0 as double) as div, {', '.join(PAIRS)} from wo where ord = 0
  union all select wo.stream, wo.ord, {_dist2('wo', 'fold')} as div, {_upd2(TRACK, 'fold', 'wo')}
  from fold join wo on wo.stream = fold.stream and wo.ord = fold.ord + 1)"""


@query("ewma_correlation", f"""{_EWMA_SQL}, z as (select fold.* from fold join (select stream, max(ord) as ord from wo group by stream) m using (stream, ord))
{' union all '.join(f"select stream, '{p}' as pair, {r6(p)} as r from z" for p in PAIRS)}""")
def ewma_correlation(spark, d):
    b = online.ewma_baseline(ship_matrices(spark, d), ["stream"], "ord", "r", TRACK)
    return b.select("stream", F.inline(F.arrays_zip(F.array(*[F.lit(p) for p in PAIRS]).alias("pair"),
                                                    F.col("state").alias("r")))).toDF("stream", "pair", "r") \
        .withColumn("r", F.round("r", 6) + 0.0)


@query("ewma_divergence", f"{_EWMA_SQL} select stream, ord, {r6('div')} as divergence from fold")
def ewma_divergence(spark, d):
    t = online.ewma_trail(ship_matrices(spark, d), ["stream"], "ord", "r", TRACK)
    return t.withColumn("divergence", F.round("divergence", 6))


_B0 = f"b0 as (select {corr_sql(FEATS)} from lib where attack = 0 and split = 'train')"
_BS_SQL = f"""{fx.LIW_SQL}, {_WM}, {_B0},
bw as (select *, row_number() over (partition by stream order by ord) - 1 as k from wo where split = 'train' and benign >= 0.9 and n >= 2),
bs as (select stream, cast(-1 as bigint) as k, cast(null as double) as score, {', '.join(PAIRS)} from b0, (select distinct stream from bw)
  union all select bw.stream, bw.k, {_dist('bw', 'bs')} as score, {_upd(ALPHA, 'bs', 'bw')}
  from bs join bw on bw.stream = bs.stream and bw.k = bs.k + 1)"""


def _start(spark, d) -> list[float]:
    x = fx.li_blocks(spark, d).filter((F.col("attack") == 0) & (F.col("split") == "train"))
    b = co.baseline(x, FEATS)
    return [b[p] for p in PAIRS]


def benign_scores(w, start):
    """Calibration scores of the benign training windows, and the numbering they use."""
    ok = w.filter((F.col("is_train") == 1) & (F.col("benign_fraction") >= 0.9) & (F.col("n") >= 2))
    ok = ok.select("stream", F.col("ord").alias("t"), "r")
    k = with_position(add_slices(ok, F.col("t")), ["stream"], [F.col("t")], "k").drop("_slice")
    return online.benign_scores(k, ["stream"], "k", start, ALPHA)


@query("benign_window_scores", f"""with recursive {_BS_SQL} select stream, k, {r6('score')} as score from bs where k >= 0""")
def benign_window_scores(spark, d):
    s = benign_scores(ship_matrices(spark, d), _start(spark, d))
    return s.select("stream", "k", F.round("divergence", 6).alias("score"))


_GATE_SQL = f"""with recursive {_BS_SQL},
cal as (select avg(score) as m, stddev_samp(score) as s from bs where k >= 0),
fold as (select stream, cast(-1 as bigint) as ord, cast(0.0 as double) as div, cast(0.0 as double) as cusum, 0 as alarm, 0 as updated,
                {', '.join(PAIRS)} from b0, (select distinct stream from wo)
  union all select stream, ord, div, case when s1 >= 5.0 then 0.0 else s1 end, case when s1 >= 5.0 then 1 else 0 end,
         case when s1 < 5.0 and benign >= 0.9 and n >= 2 then 1 else 0 end,
         {', '.join(f'case when s1 < 5.0 and benign >= 0.9 and n >= 2 then {ALPHA} * n_{p} + {1 - ALPHA} * o_{p} else o_{p} end as {p}' for p in PAIRS)}
  from (select wo.stream, wo.ord, wo.benign, wo.n, {_dist2('wo', 'fold')} as div,
               greatest(0.0, fold.cusum + ({_dist2('wo', 'fold')} - m) / s - 0.5) as s1,
               {', '.join(f'wo.{p} as n_{p}, fold.{p} as o_{p}' for p in PAIRS)}
        from fold join wo on wo.stream = fold.stream and wo.ord = fold.ord + 1, cal))"""


def calibrated(spark, d):
    w = ship_matrices(spark, d)
    start = _start(spark, d)
    return w, start, online.calibrate(benign_scores(w, start), "divergence", allow_empty=True)


@query("gated_adaptation", f"""{_GATE_SQL}
select stream, ord, {r6('div')} as divergence, {r6('cusum')} as cusum, alarm, updated from fold where ord >= 0""")
def gated_adaptation(spark, d):
    w, start, det = calibrated(spark, d)
    g = online.gated_adaptation(w, ["stream"], "ord", start, det, ALPHA)
    return g.select("stream", "ord", F.round("divergence", 6).alias("divergence"), F.round("cusum", 6).alias("cusum"),
                    "alarm", "updated")


@query("adaptation_summary", f"""{_GATE_SQL}
select stream, cast(0.5 as double) as k, cast(5.0 as double) as h, {r6('max(m)')} as mean, {r6('max(s)')} as std,
       {r6('arg_max(cusum, ord)')} as cusum, count(*) as n_samples, cast(sum(alarm) as bigint) as n_changes,
       cast({ALPHA} as double) as alpha, cast(sum(updated) as bigint) as n_updates from fold, cal where ord >= 0 group by stream""")
def adaptation_summary(spark, d):
    """Final state of the fold and its counts, one row per stream."""
    w, start, det = calibrated(spark, d)
    g = online.gated_adaptation(w, ["stream"], "ord", start, det, ALPHA).groupBy("stream").agg(
        F.max_by("cusum", "ord").alias("cusum"), F.count(F.lit(1)).alias("n_samples"),
        F.sum("alarm").cast("long").alias("n_changes"), F.sum("updated").cast("long").alias("n_updates"))
    return g.select("stream", F.lit(det.k).alias("k"), F.lit(det.h).alias("h"), F.round(F.lit(det.mean), 6).alias("mean"),
                    F.round(F.lit(det.std), 6).alias("std"), F.round("cusum", 6).alias("cusum"), "n_samples", "n_changes",
                    F.lit(ALPHA).alias("alpha"), "n_updates")
