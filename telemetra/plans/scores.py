"""Thresholds and detection metrics on the scored stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.operators.ordering import join_null_safe
from telemetra.functions.numeric import ratio
from telemetra.operators import metrics, splits, thresholds, windows
from telemetra.plans.registry import frac, query, r6
from telemetra.session import materialize
from telemetra.sources import fixtures as fx
from telemetra.sources.tables import as_result_rows

T = 0.35


def windowed(spark, d):
    """Scored rows with block and window, stored once: threshold searches read them several times."""
    return materialize(fx.scored_windows(spark, d).select("event_id", "block", "win", "y", "p"))


_PRED = f"case when p >= {T} then 1 else 0 end"
_CONF = """count(*) filter (y = 1 and pred = 1) as tp, count(*) filter (y = 0 and pred = 1) as fp,
count(*) filter (y = 1 and pred = 0) as fn, count(*) filter (y = 0 and pred = 0) as tn"""
_CM_SQL = f"{fx.SCORED_SQL}, pr as (select *, {_PRED} as pred from scored), cm as (select {_CONF} from pr)"
_F1, _F0 = frac("2 * tp", "2 * tp + fp + fn"), frac("2 * tn", "2 * tn + fp + fn")
_RATES = {
    "precision": frac("tp", "tp + fp"), "recall": frac("tp", "tp + fn"), "f1": _F1, "fpr": frac("fp", "fp + tn"),
    "precision_0": frac("tn", "tn + fn"), "recall_0": frac("tn", "tn + fp"), "f1_0": _F0,
    "accuracy": frac("tp + tn", "tp + fp + fn + tn"),
    "weighted_f1": frac(f"({_F1} * (tp + fn) + {_F0} * (tn + fp))", "tp + fp + fn + tn"),
}
_RATE_SQL = ", ".join(f"{r6(v)} as {k}" for k, v in _RATES.items())
#: score curve: tp / fp when each distinct score is the threshold
_CURVE = """cv as (
  select p, sum(y) as pos, count(*) - sum(y) as neg, cast(sum(sum(y)) over (order by p desc) as bigint) as tp,
         cast(sum(count(*) - sum(y)) over (order by p desc) as bigint) as fp, sum(sum(y)) over () as np,
         sum(count(*) - sum(y)) over () as nn from scored group by p)"""


def predicted(spark, d, t: float = T):
    return fx.scored(spark, d).withColumn("pred", F.when(F.col("p") >= t, 1).otherwise(0))


@query("confusion_counts", f"with {_CM_SQL} select * from cm")
def confusion_counts(spark, d):
    return metrics.confusion_counts(predicted(spark, d))


@query("detection_metrics", f"with {_CM_SQL} select tp, fp, fn, tn, {_RATE_SQL} from cm")
def detection_metrics(spark, d):
    return metrics.with_rates(metrics.confusion_counts(predicted(spark, d)))


_AUC = "sum(cast(neg as double) * ((tp - pos) + pos / 2.0)) / (cast(max(np) as double) * max(nn))"


@query("roc_auc", f"with {fx.SCORED_SQL}, {_CURVE} select {r6(_AUC)} as roc_auc from cv")
def roc_auc(spark, d):
    return metrics.roc_auc(fx.scored(spark, d)).withColumn("roc_auc", F.round("roc_auc", 6))


@query("average_precision", f"""with {fx.SCORED_SQL}, {_CURVE}
select {r6('sum(pos * (tp / cast(tp + fp as double))) / max(np)')} as average_precision from cv""")
def average_precision(spark, d):
    return metrics.average_precision(fx.scored(spark, d)).withColumn(
        "average_precision", F.round("average_precision", 6))


@query("roc_curve", f"""with {fx.SCORED_SQL}, {_CURVE}
select p as threshold, {r6('fp / cast(nn as double)')} as fpr, {r6('tp / cast(np as double)')} as tpr from cv""")
def roc_curve(spark, d):
    counts = metrics.score_counts(fx.scored(spark, d))
    n_pos, n_neg = metrics.curve_totals(counts)
    return metrics.curve_of(counts).select(
        F.col("p").alias("threshold"), F.round(ratio(F.col("fp"), F.lit(n_neg)), 6).alias("fpr"),
        F.round(ratio(F.col("tp"), F.lit(n_pos)), 6).alias("tpr"))


@query("pr_curve", f"""with {fx.SCORED_SQL}, {_CURVE}
select p as threshold, {r6('tp / cast(tp + fp as double)')} as precision, {r6('tp / cast(np as double)')} as recall from cv""")
def pr_curve(spark, d):
    counts = metrics.score_counts(fx.scored(spark, d))
    n_pos, _ = metrics.curve_totals(counts)
    return metrics.curve_of(counts).select(
        F.col("p").alias("threshold"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(ratio(F.col("tp"), F.lit(n_pos)), 6).alias("recall"))


def _rep(name: str, p: str, r: str, f: str, s: str) -> str:
    return f'select \'{name}\' as "row", {r6(p)} as precision, {r6(r)} as recall, {r6(f)} as f1, {s} as support from rt'


_W = "({0} * (tp + fn) + {0}_0 * (tn + fp)) / cast(tp + fp + fn + tn as double)"


@query("classification_report", f"""with {_CM_SQL},
rt as (select tp, fp, fn, tn, {', '.join(f'{v} as {k}' for k, v in _RATES.items())} from cm)
{_rep('0', 'precision_0', 'recall_0', 'f1_0', 'tn + fp')}
union all {_rep('1', 'precision', 'recall', 'f1', 'tp + fn')}
union all {_rep('accuracy', 'accuracy', 'accuracy', 'accuracy', 'tp + fp + fn + tn')}
union all {_rep('macro avg', '(precision + precision_0) / 2', '(recall + recall_0) / 2', '(f1 + f1_0) / 2', 'tp + fp + fn + tn')}
union all {_rep('weighted avg', _W.format('precision'), _W.format('recall'), _W.format('f1'), 'tp + fp + fn + tn')}""")
def classification_report(spark, d):
    return metrics.classification_report(predicted(spark, d))


_META = {"dataset": "events", "method": "score", "config": "default", "feature_set": "value",
         "split_policy": "standard", "threshold_selected_on": "validation", "notes": ""}


@query("result_row", f"""with {_CM_SQL}, {_CURVE}, auc as (select {r6(_AUC)} as roc_auc from cv)
select {', '.join(f"'{v}' as {k}" for k, v in _META.items())}, 42 as seed, tp, fp, fn, tn,
  {', '.join(f'{r6(_RATES[k])} as {k}' for k in ('precision', 'recall', 'f1', 'fpr', 'accuracy', 'weighted_f1'))},
  roc_auc, cast({T} as double) as threshold, cast(0 as bigint) as n_train, tp + fp + fn + tn as n_test,
  cast(0 as double) as inference_latency_ms, cast(0 as double) as model_size_kb from cm, auc""")
def result_row(spark, d):
    """The 24-column result row, metadata defaults included."""
    s = predicted(spark, d)
    auc = metrics.roc_auc(s).first()["roc_auc"]
    row = metrics.with_rates(metrics.confusion_counts(s)).withColumns(
        {**{k: F.lit(v) for k, v in _META.items()}, "seed": F.lit(42),
         "roc_auc": F.round(F.lit(auc), 6), "threshold": F.lit(T), "n_train": F.lit(0).cast("long"),
         "n_test": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"),
         "inference_latency_ms": F.lit(0.0), "model_size_kb": F.lit(0.0)})
    return as_result_rows(row)


@query("f1_optimal_threshold", f"""with {fx.SCORED_SQL}, {_CURVE}, f as (
  select p, tp / cast(tp + fp as double) as pr, tp / cast(np as double) as re from cv)
select p as threshold, {r6('2 * pr * re / (pr + re + 1e-12)')} as f1 from f
order by 2 * pr * re / (pr + re + 1e-12) desc, p limit 1""")
def f1_optimal_threshold(spark, d):
    return thresholds.exact_f1(fx.scored(spark, d)).withColumn("f1", F.round("f1", 6))


_GRID = """grid as (select cast(0.01 as double) + i * cast(0.01 as double) as t from range(0, 99) r(i))"""


def _grid_sql(keys: str, src: str, out: str) -> str:
    """Brute force over rows x grid: F1-optimal grid threshold per key."""
    part = f"partition by {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""{out}_o as (
  select {k}t, count(*) as n, sum(y) as n_pos, count(*) filter (y = 1 and p >= t) as tp,
         count(*) filter (y = 0 and p >= t) as fp from {src}, grid group by {k}t),
{out}_f as (select *, {frac('2 * tp', 'tp + fp + n_pos')} as f1 from {out}_o),
{out}_b as (select *, max(f1) over ({part}) as best from {out}_f),
{out} as (select {k}n, n_pos, t as threshold, best as f1 from (
  select *, row_number() over ({part} order by round(abs(t - 0.5), 9), t) as rn from {out}_b
  where best - f1 <= 1e-8 + 1e-5 * best) where rn = 1)"""


@query("grid_f1_threshold", f"""with {fx.SCORED_SQL}, {_GRID}, {_grid_sql('', 'scored', 'g')}
select {r6('threshold')} as threshold, {r6('f1')} as f1 from g""")
def grid_f1_threshold(spark, d):
    return thresholds.grid_f1(fx.scored(spark, d)).select(
        F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


_WT_SQL = f"""{fx.SCOREDW_SQL}, {_GRID}, {_grid_sql('', 'scored', 'g')}, {_grid_sql('block, win', 'scored', 'l')},
gl as (select block, win, count(*) filter (y = 1 and p >= g.threshold) as tp, count(*) filter (y = 0 and p >= g.threshold) as fp,
              count(*) filter (y = 1 and p < g.threshold) as fn from scored, g group by block, win),
wt as (select l.block, l.win, l.n, case when l.n_pos > 0 and l.n_pos < l.n then l.threshold else g.threshold end as threshold,
              case when l.n_pos > 0 and l.n_pos < l.n then l.f1 else {_F1} end as f1, g.threshold as gt
       from l join gl using (block, win), g)"""


@query("window_thresholds", f"""with {_WT_SQL}
select block, win, n, {r6('threshold')} as threshold, {r6('f1')} as f1 from wt""")
def window_thresholds(spark, d):
    w, _ = thresholds.window_thresholds(windowed(spark, d), ["block", "win"], fx.EV_WINDOW)
    return w.select("block", "win", "n", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query("threshold_stats", f"""with {_WT_SQL}
select {r6('min(threshold)')} as min, {r6('avg(threshold)')} as mean, {r6('max(threshold)')} as max,
       {r6('stddev_pop(threshold)')} as std, count(*) as n_windows, {r6('max(gt)')} as global_threshold from wt""")
def threshold_stats(spark, d):
    w, g = thresholds.window_thresholds(windowed(spark, d), ["block", "win"], fx.EV_WINDOW)
    t = "threshold"
    return w.agg(F.round(F.min(t), 6).alias("min"), F.round(F.avg(t), 6).alias("mean"),
                 F.round(F.max(t), 6).alias("max"), F.round(F.stddev_pop(t), 6).alias("std"),
                 F.count(F.lit(1)).alias("n_windows"), F.round(F.lit(g["threshold"]), 6).alias("global_threshold"))


def _windowed_predictions(spark, d, last: bool = False, complete_only: bool = False):
    """Thresholds learned on validation blocks, applied window by window to test blocks.

    Prediction window k takes threshold k mod n (or the last one beyond n).
    Windows are numbered across blocks through a one-row-per-block offset table.
    """
    s = windowed(spark, d)
    val, test = s.filter(F.col("block") % 5 == 3), s.filter(F.col("block") % 5 == 4)
    if complete_only:
        sizes = test.groupBy("block", "win").agg(F.count(F.lit(1)).alias("n"))
        test = join_null_safe(test, sizes.filter(F.col("n") == fx.EV_WINDOW).drop("n"), ["block", "win"])
    learned, _ = thresholds.window_thresholds(val, ["block", "win"], fx.EV_WINDOW)
    learned = windows.with_ordinal(learned, "block", name="slot").select("slot", "threshold")
    n = learned.count()
    tw = windows.with_ordinal(test.select("block", "win").distinct(), "block")
    slot = F.least(F.col("ord"), F.lit(n - 1)) if last else F.pmod(F.col("ord"), F.lit(n))
    tw = tw.select("block", "win", slot.alias("slot")).join(learned, "slot").drop("slot")
    return join_null_safe(test, tw, ["block", "win"]).withColumn(
        "pred", F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0))


def _cyc_sql(last: bool, complete: bool) -> str:
    slot = "least(ord, (select count(*) from lrn) - 1)" if last else "ord % (select count(*) from lrn)"
    having = f"having count(*) = {fx.EV_WINDOW}" if complete else ""
    return f"""{fx.SCOREDW_SQL}, val as (select * from scored where block % 5 = 3), {_GRID},
{_grid_sql('', 'val', 'g')}, {_grid_sql('block, win', 'val', 'l')},
lrn as (select row_number() over (order by l.block, l.win) - 1 as slot,
               case when l.n_pos > 0 and l.n_pos < l.n then l.threshold else g.threshold end as threshold from l, g),
tw as (select block, win, row_number() over (order by block, win) - 1 as ord from (
       select block, win from scored where block % 5 = 4 group by block, win {having})),
tt as (select block, win, threshold from (select *, {slot} as slot from tw) join lrn using (slot)),
pr as (select scored.*, threshold, case when p >= threshold then 1 else 0 end as pred from scored join tt using (block, win))"""


@query("cyclic_thresholds", f"""with {_cyc_sql(False, False)}
select event_id, {r6('threshold')} as threshold, pred from pr""")
def cyclic_thresholds(spark, d):
    return _windowed_predictions(spark, d).select("event_id", F.round("threshold", 6).alias("threshold"), "pred")


@query("pipeline_metrics", f"""with {_cyc_sql(False, False)}, cm as (select {_CONF} from pr)
select tp, fp, fn, tn, {_RATE_SQL} from cm""")
def pipeline_metrics(spark, d):
    """Metrics of the actual predictions; weighted F1 follows the same predictions."""
    return metrics.with_rates(metrics.confusion_counts(_windowed_predictions(spark, d)))


@query("window_fpr_stats", f"""with {_cyc_sql(True, True)},
w as (select block, win, max(threshold) as threshold, {_CONF} from pr group by block, win),
f as (select *, {frac('fp', 'fp + tn')} as fpr from w)
select count(*) as n_windows, {r6('coalesce(avg(fpr), 0)')} as fpr_mean, {r6('coalesce(var_pop(fpr), 0)')} as fpr_var,
       {r6('coalesce(max(fpr), 0)')} as fpr_max, {r6('coalesce(stddev_pop(threshold), 0)')} as threshold_std, count(*) filter (fp + tn = 0) as n_without_negatives from f""")
def window_fpr_stats(spark, d):
    p = _windowed_predictions(spark, d, last=True, complete_only=True)
    w = metrics.confusion_counts(p, keys=["block", "win", "threshold"])
    return metrics.window_fpr(w)


@query("fpr_constrained_threshold", f"""with {fx.SCORED_SQL},
grid as (select round(cast(0.5 as double) + i * cast(0.01 as double), 10) as t from range(0, 50) r(i)),
o as (select t, sum(y) as n_pos, count(*) - sum(y) as n_neg, count(*) filter (y = 1 and p >= t) as tp,
             count(*) filter (y = 0 and p >= t) as fp from scored, grid group by t),
r as (select t, {frac('2 * tp', 'tp + fp + n_pos')} as f1, {frac('tp', 'n_pos')} as recall, {frac('fp', 'n_neg')} as fpr from o)
select {r6('t')} as threshold, {r6('f1')} as f1, {r6('recall')} as recall, {r6('fpr')} as fpr from r where fpr <= 0.05
order by round(r.f1, 8) desc, round(r.recall, 8) desc, r.fpr, t limit 1""")
def fpr_constrained_threshold(spark, d):
    return thresholds.fpr_constrained(fx.scored(spark, d)).select(
        *[F.round(c, 6).alias(c) for c in ("threshold", "f1", "recall", "fpr")])


def _adaptive(spark, d):
    """Exact threshold inside each complete window (labels known); others carry it forward."""
    s = windowed(spark, d)
    g = thresholds.exact_f1(s).first()["threshold"]
    t = thresholds.exact_f1_per_window(s, ["block", "win"])
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    t = t.withColumn("threshold", F.when(both, F.col("threshold")).otherwise(F.lit(g)))
    t = windows.carry_values(t, ["block"], fx.EV_WINDOW, "threshold")
    joined = s.join(t, ["block", "win"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(g)))
    return joined.withColumn("pred_static", F.when(F.col("p") >= g, 1).otherwise(0)) \
                 .withColumn("pred_adaptive", F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0))


_AD_SQL = f"""{fx.SCOREDW_SQL}, {_CURVE},
gt as (select p as t from (select p, tp / cast(tp + fp as double) as pr, tp / cast(np as double) as re from cv)
       order by 2 * pr * re / (pr + re + 1e-12) desc, p limit 1),
ws as (select block, win, count(*) as n, sum(y) as n_pos from scored group by all),
wc as (select block, win, p, cast(sum(sum(y)) over w as bigint) as tp, cast(sum(count(*) - sum(y)) over w as bigint) as fp
       from scored group by block, win, p window w as (partition by block, win order by p desc)),
wf as (select wc.*, n, n_pos, {frac('tp', 'tp + fp')} as pr, {frac('tp', 'n_pos')} as re from wc join ws using (block, win)),
wb as (select block, win, n, n_pos, p, row_number() over (partition by block, win
         order by 2 * pr * re / (pr + re + 1e-12) desc, p) as rn from wf),
wthr as (select block, win, case when n_pos > 0 and n_pos < n then p else gt.t end as t from wb, gt where rn = 1 and n = {fx.EV_WINDOW}),
ad as (select s.*, gt.t as st, coalesce(a.t, b.t, gt.t) as t from scored s left join wthr a on a.block = s.block and a.win = s.win
       left join wthr b on b.block = s.block and b.win = s.win - 1, gt),
pa as (select *, case when p >= st then 1 else 0 end as ps, case when p >= t then 1 else 0 end as pd from ad)"""


def _two(table: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    by = f"group by {group}" if group else ""
    return " union all ".join(
        f"select {g}'{m}' as mode, {_CONF.replace('pred', c)} from {table} {by}"
        for m, c in (("static", "ps"), ("adaptive", "pd")))


@query("adaptive_vs_static", f"""with {_AD_SQL}, cm as ({_two('pa')})
select mode, tp, fp, fn, tn, {r6(_RATES['f1'])} as f1, {r6(_RATES['fpr'])} as fpr from cm""")
def adaptive_vs_static(spark, d):
    a = _adaptive(spark, d)
    both = a.select("y", F.explode(F.array(
        F.struct(F.lit("static").alias("mode"), F.col("pred_static").alias("pred")),
        F.struct(F.lit("adaptive").alias("mode"), F.col("pred_adaptive").alias("pred")))).alias("m"))
    c = metrics.confusion_counts(both.select("y", "m.*"), keys=["mode"])
    return metrics.with_rates(c, ["f1", "fpr"])


def _window_confusions(spark, d):
    a = _adaptive(spark, d)
    agg = {}
    for m in ("static", "adaptive"):
        for k, v in metrics.confusion(F.col("y"), F.col(f"pred_{m}")).items():
            agg[f"{k}_{m}"] = v
    w = a.groupBy("block", "win").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"),
                                      *[v.alias(k) for k, v in agg.items()])
    return w.filter(F.col("n") == fx.EV_WINDOW)


def _f1_of(m: str):
    tp, fp, fn = (F.col(f"{k}_{m}") for k in ("tp", "fp", "fn"))
    return ratio(2 * tp, 2 * tp + fp + fn)


@query("window_f1_gain", f"""with {_AD_SQL}, cm as ({_two('pa', 'block, win')}),
f as (select block, win, mode, {_F1} as f1 from cm join ws using (block, win) where n = {fx.EV_WINDOW} and n_pos > 0 and n_pos < n)
select block, win, {r6("max(f1) filter (mode = 'static')")} as f1_static, {r6("max(f1) filter (mode = 'adaptive')")} as f1_adaptive,
       {r6("max(f1) filter (mode = 'adaptive') - max(f1) filter (mode = 'static')")} as gain from f group by block, win""")
def window_f1_gain(spark, d):
    w = _window_confusions(spark, d).filter((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")))
    return w.select("block", "win", F.round(_f1_of("static"), 6).alias("f1_static"),
                    F.round(_f1_of("adaptive"), 6).alias("f1_adaptive"),
                    (F.round(_f1_of("adaptive") - _f1_of("static"), 6) + 0.0).alias("gain"))


@query("borderline_fpr", f"""with {_AD_SQL}, cm as ({_two('pa', 'block, win')}),
f as (select mode, {frac('fp', 'fp + tn')} as fpr from cm join ws using (block, win)
      where n = {fx.EV_WINDOW} and n_pos / cast(n as double) between 0.05 and 0.40),
a as (select count(*) filter (mode = 'static') as n_windows, avg(fpr) filter (mode = 'static') as s, stddev_pop(fpr) filter (mode = 'static') as ss,
             avg(fpr) filter (mode = 'adaptive') as a, stddev_pop(fpr) filter (mode = 'adaptive') as sa from f)
select n_windows, {r6('s')} as static_mean, {r6('ss')} as static_std, {r6('a')} as adaptive_mean, {r6('sa')} as adaptive_std,
       {r6('(s - a) / (s + 1e-10) * 100', 4)} as reduction_pct from a""")
def borderline_fpr(spark, d):
    w = _window_confusions(spark, d).filter((F.col("n_pos") / F.col("n")).between(0.05, 0.40))
    for m in ("static", "adaptive"):
        w = w.withColumn(f"_{m}", ratio(F.col(f"fp_{m}"), F.col(f"fp_{m}") + F.col(f"tn_{m}")))
    s, a = F.avg("_static"), F.avg("_adaptive")
    return w.agg(F.count(F.lit(1)).alias("n_windows"), F.round(s, 6).alias("static_mean"),
                 F.round(F.stddev_pop("_static"), 6).alias("static_std"), F.round(a, 6).alias("adaptive_mean"),
                 F.round(F.stddev_pop("_adaptive"), 6).alias("adaptive_std"),
                 F.round((s - a) / (s + 1e-10) * 100, 4).alias("reduction_pct"))


@query("split_status", f"""with {fx.EVB_SQL}
select case block % 5 when 4 then 'test' when 3 then 'val' else 'train' end as split, count(*) as n_rows,
       cast(sum(label) as bigint) as n_attack, case when sum(label) = 0 or sum(label) = count(*) then 'blocked' else 'ok' end as status
from evb group by 1""")
def split_status(spark, d):
    """A one-class split yields a blocked record with its counts, never a threshold."""
    part = F.when(F.col("block") % 5 == 4, "test").when(F.col("block") % 5 == 3, "val").otherwise("train")
    s = splits.block_stats(fx.ev_blocks(spark, d).withColumn("split", part), ["split"])
    return s.select("split", "n_rows", F.col("n_pos").alias("n_attack"),
                    F.when(splits.stratum(F.col("n_rows"), F.col("n_pos")) == 1, "ok").otherwise("blocked").alias("status"))


@query("candidate_ratios", f"""with {fx.EV_SQL}, c as (select sum(label) as a, count(*) - sum(label) as b from ev),
n as (select greatest(a, b) / cast(greatest(1, least(a, b)) as double) as nat from c),
g as (select unnest([1.0, 1.25, 1.5, 2.0, 5.0, 10.0])::double as ratio)
select ratio from g, n where ratio < nat - 1e-9 union all select {r6('nat', 4)} from n""")
def candidate_ratios(spark, d):
    c = fx.ev(spark, d).agg(F.sum("label").alias("a"), (F.count(F.lit(1)) - F.sum("label")).alias("b"))
    natural = F.greatest("a", "b") / F.greatest(F.lit(1), F.least("a", "b"))
    grid = F.array(*[F.lit(r) for r in (1.0, 1.25, 1.5, 2.0, 5.0, 10.0)])
    return c.select(natural.alias("nat")).select(F.explode(F.concat(
        F.filter(grid, lambda r: r < F.col("nat") - 1e-9), F.array(F.round("nat", 4)))).alias("ratio"))
