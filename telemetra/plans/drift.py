"""Attribution and rank drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.functions.numeric import ratio
from telemetra.operators import attribution as at
from telemetra.operators import windows
from telemetra.operators.ordering import add_slices, join_null_safe, with_position
from telemetra.plans import windows as wq
from telemetra.plans.graph import KEYS
from telemetra.plans.registry import frac, query, r6
from telemetra.session import materialize
from telemetra.sources import fixtures as fx

FEATS = fx.LI_FEATURES
N = fx.LI_WINDOW
_ROWKEY = fx.LI_KEYS[1:5]


def model(spark, d):
    return at.fit_linear(fx.li_blocks(spark, d).filter("split = 'train'"), FEATS)


_MODEL_SQL = "par as (select " + ", ".join(
    f"case when var_pop({f}) > 0 then (avg({f}) filter (label = 1) - avg({f}) filter (label = 0)) / var_pop({f}) else 0.0 end as w_{f}, "
    f"avg({f}) as m_{f}" for f in FEATS) + " from lib where split = 'train')"
_IMP = ", ".join(f"avg(abs(w_{f} * ({f} - m_{f}))) as imp_{f}" for f in FEATS)
_RANKS = ", ".join("(" + " + ".join(
    f"case when imp_{g} {'>=' if j < i else '>'} imp_{f} then 1 else 0 end"
    for j, g in enumerate(FEATS) if j != i) + f") as rank_{f}" for i, f in enumerate(FEATS))


def _tau(a: str, b: str) -> str:
    pairs = [(x, y) for i, x in enumerate(FEATS) for y in FEATS[i + 1:]]
    return "((" + " + ".join(f"sign(({a}.rank_{x} - {a}.rank_{y}) * ({b}.rank_{x} - {b}.rank_{y}))" for x, y in pairs) \
        + f") / cast({len(pairs)} as double))"


_WI_SQL = f"""{fx.LIW_SQL}, {_MODEL_SQL},
wi as (select stream, block, win, count(*) as n, avg(label) as frac, {_IMP} from liw, par group by stream, block, win),
wr as (select *, {_RANKS} from wi where n = {N})"""
_REF_SQL = f"ref as (select {_RANKS} from (select {_IMP} from lib, par where split = 'train'))"
_TAU_SQL = f"{_WI_SQL}, {_REF_SQL}, ta as (select wr.*, {_tau('wr', 'ref')} as tau from wr, ref)"


def ranked_windows(spark, d, m):
    w = at.window_importance(fx.li_windows(spark, d), [*KEYS, "win"], m)
    return at.with_ranks(windows.complete(w, N), FEATS)


@query("linear_attribution", f"""with {fx.LIB_SQL}, {_MODEL_SQL}
select {', '.join(_ROWKEY)}, {', '.join(f'{r6(f"w_{f} * ({f} - m_{f})")} as a_{f}' for f in FEATS)} from lib, par""")
def linear_attribution(spark, d):
    a = at.attributions(model(spark, d))
    return fx.li_blocks(spark, d).select(*_ROWKEY, *[(F.round(c, 6) + 0.0).alias(k) for k, c in a.items()])


@query("window_importance", f"""with {_WI_SQL}
{' union all '.join(f"select stream, block, win, n, '{f}' as feature, {r6(f'imp_{f}')} as importance from wi" for f in FEATS)}""")
def window_importance(spark, d):
    w = at.window_importance(fx.li_windows(spark, d), [*KEYS, "win"], model(spark, d))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"imp_{f}", 6).alias("importance")) for f in FEATS])
    return w.select(*KEYS, "win", "n", F.inline(rows))


def _long_ranks(df, keys):
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"rank_{f}").alias("rank")) for f in FEATS])
    return df.select(*keys, F.inline(rows))


@query("importance_ranks", f"""with {_WI_SQL}
{' union all '.join(f"select stream, block, win, '{f}' as feature, rank_{f} as rank from wr" for f in FEATS)}""")
def importance_ranks(spark, d):
    return _long_ranks(ranked_windows(spark, d, model(spark, d)), [*KEYS, "win"])


@query("reference_ranking", f"""with {fx.LIB_SQL}, {_MODEL_SQL}, i as (select {_IMP} from lib, par where split = 'train'),
r as (select *, {_RANKS} from i)
{' union all '.join(f"select '{f}' as feature, {r6(f'imp_{f}')} as importance, rank_{f} as rank from r" for f in FEATS)}""")
def reference_ranking(spark, d):
    m = model(spark, d)
    i = fx.li_blocks(spark, d).filter("split = 'train'").agg(*[c.alias(k) for k, c in at.importance(m).items()])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"imp_{f}", 6).alias("importance"),
                              F.col(f"rank_{f}").alias("rank")) for f in FEATS])
    return at.with_ranks(i, FEATS).select(F.inline(rows))


def _taus(spark, d):
    m = model(spark, d)
    ref = at.reference_ranks(fx.li_blocks(spark, d).filter("split = 'train'"), m)
    return at.tau_vs_reference(ranked_windows(spark, d, m), FEATS, ref)


@query("kendall_vs_reference", f"""with {_TAU_SQL}
select stream, block, win, {r6('tau')} as tau, case when tau < 0.7 then 1 else 0 end as drift from ta""")
def kendall_vs_reference(spark, d):
    return _taus(spark, d).select(*KEYS, "win", (F.round("tau", 6) + 0.0).alias("tau"), "drift")


@query("drift_summary", f"""with {_TAU_SQL}
select count(*) as n_windows, count(*) filter (tau < 0.7) as n_drift, {r6('avg(case when tau < 0.7 then 1 else 0 end)')} as drift_rate,
       {r6('min(tau)')} as tau_min, {r6('avg(tau)')} as tau_mean, {r6('max(tau)')} as tau_max, {r6('stddev_pop(tau)')} as tau_std from ta""")
def drift_summary(spark, d):
    return at.drift_summary(_taus(spark, d))


_SHIFT_SQL = f"""{_WI_SQL}, wo as (select *, row_number() over (partition by stream order by block, win) - 1 as ord from wr),
sh as (select b.stream, b.block, b.win, b.ord, case when a.ord is null then 0.0 else 1.0 - {_tau('a', 'b')} end as shift
       from wo b left join wo a on a.stream = b.stream and a.ord = b.ord - 1),
sf as (select sh.*, case when shift > m + 1.5 * s then 1 else 0 end as flag from sh,
       (select avg(shift) as m, stddev_pop(shift) as s from sh))"""


def shifts(spark, d):
    """1 - tau between consecutive windows of a stream; the first window scores 0."""
    r = materialize(ranked_windows(spark, d, model(spark, d)).select(*KEYS, "win", *[f"rank_{f}" for f in FEATS]))
    w = windows.with_ordinal(r, "block", ["stream"])
    w = windows.with_preceding(w, ["stream"], {f"rank_{f}": f"prev_{f}" for f in FEATS}, "ord")
    tau = at.kendall(FEATS, {f: F.col(f"prev_{f}") for f in FEATS}, {f: F.col(f"rank_{f}") for f in FEATS})
    w = w.withColumn("shift", F.when(F.col(f"prev_{FEATS[0]}").isNull(), 0.0).otherwise(1.0 - tau))
    return at.shift_flags(w)


@query("rank_shift", f"with {_SHIFT_SQL} select stream, block, win, ord, {r6('shift')} as shift, flag from sf")
def rank_shift(spark, d):
    return shifts(spark, d).select(*KEYS, "win", "ord", (F.round("shift", 6) + 0.0).alias("shift"), "flag")


@query("drift_feature", f"""with {_WI_SQL}, wo as (select wr.*, lag(wr) over (partition by stream order by block, win) as p from wr),
sh as (select stream, block, win, case when p is null then 0.0 else 1.0 - {_tau('wo', 'p')} end as shift from wo),
sf as (select stream, block, win, case when shift > avg(shift) over () + 1.5 * stddev_pop(shift) over () then 1 else 0 end as flag from sh),
fl as (select * from sf union all select stream, block, max(win) + 1, arg_max(flag, win) from sf group by stream, block)
select {', '.join(f'liw.{k}' for k in _ROWKEY)}, fl.flag as drift_flag from liw left join fl using (stream, block, win)""")
def drift_feature(spark, d):
    """The window's flag on each of its rows; a block's remainder carries the last one."""
    s = shifts(spark, d).select(*KEYS, "win", "flag").withColumn("n", F.lit(N))
    f = windows.carry_values(s, KEYS, N, "flag")
    return join_null_safe(fx.li_windows(spark, d), f, [*KEYS, "win"], "left").select(
        *_ROWKEY, F.col("flag").alias("drift_flag"))


@query("topk_feature_ranks", f"""with {_WI_SQL}, g as (
{' union all '.join(f"select '{f}' as feature, {i} as ix, avg(imp_{f}) as g from wr" for i, f in enumerate(FEATS))}),
top as (select feature from g order by g desc, ix limit 3),
l as ({' union all '.join(f"select stream, block, win, '{f}' as feature, rank_{f} as rank from wr" for f in FEATS)})
select l.* from l join top using (feature)""")
def topk_feature_ranks(spark, d):
    """Ranks over time of the three globally most important features."""
    w = ranked_windows(spark, d, model(spark, d))
    g = w.agg(*[F.avg(f"imp_{f}").alias(f) for f in FEATS]).first()
    top = sorted(FEATS, key=lambda f: (-g[f], FEATS.index(f)))[:3]
    return _long_ranks(w, [*KEYS, "win"]).filter(F.col("feature").isin(top))


@query("class_importance", f"""with {fx.LIB_SQL}, {_MODEL_SQL}, s as (select * from (
  select *, row_number() over (partition by label order by md5({" || '|' || ".join(["'5'", *_ROWKEY])}), f1, f2, f3, f4, ts) as rk from lib) where rk <= 500),
i as (select label, {_IMP} from s, par group by label)
{' union all '.join(f"select label, '{f}' as feature, {r6(f'imp_{f}')} as importance from i" for f in FEATS)}""")
def class_importance(spark, d):
    """Mean absolute attribution on 500 sampled rows of each class."""
    x = fx.li_blocks(spark, d)
    m = at.fit_linear(x.filter("split = 'train'"), FEATS)
    h = x.withColumn("_h", at.shuffle_key(5, *[F.col(k) for k in _ROWKEY]))
    order = ["_h", "f1", "f2", "f3", "f4", "ts"]
    s = [h.filter(F.col("label") == c).orderBy(*order).limit(500) for c in (0, 1)]
    i = s[0].unionByName(s[1]).groupBy("label").agg(*[c.alias(k) for k, c in at.importance(m).items()])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"imp_{f}", 6).alias("importance")) for f in FEATS])
    return i.select("label", F.inline(rows))


@query("fast_drift", f"""with {fx.LIP_SQL}, {_MODEL_SQL}, {_REF_SQL}, q as (select *, pos // 100 as win from lip),
s as (select *, count(*) over (partition by stream, block, win) as n,
             row_number() over (partition by stream, block, win order by md5('42|' || pos)) as rk from q),
wi as (select stream, block, win, {_IMP} from s, par where n = 100 and rk <= 50 group by stream, block, win),
wr as (select *, {_RANKS} from wi)
select stream, block, win, {r6(_tau('wr', 'ref'))} as tau, case when {_tau('wr', 'ref')} < 0.7 then 1 else 0 end as drift from wr, ref""")
def fast_drift(spark, d):
    """Lightweight variant: complete windows of 100 rows, 50 sampled rows each."""
    m = model(spark, d)
    ref = at.reference_ranks(fx.li_blocks(spark, d).filter("split = 'train'"), m)
    q = fx.li_windows(spark, d, 100)
    s = at.sampled(q, [*KEYS, "win"], 50, 42, ["pos"])
    full = q.groupBy(*KEYS, "win").agg(F.count(F.lit(1)).alias("size")).filter("size = 100").drop("size")
    w = join_null_safe(at.window_importance(s, [*KEYS, "win"], m), full, [*KEYS, "win"], "left_semi")
    t = at.tau_vs_reference(at.with_ranks(w, FEATS), FEATS, ref, nan_tau=0.0)
    return t.select(*KEYS, "win", (F.round("tau", 6) + 0.0).alias("tau"), "drift")


# --- flagged windows against true transitions ----------------------------------

_MATCH_SQL = f"""{wq._GW_SQL}, lvl as (select pos // {wq.W} as win, avg(f1) as v from g group by 1 having count(*) = {wq.W}),
sc as (select b.win, abs(b.v - a.v) as shift from lvl b join lvl a on a.win = b.win - 1),
fl as (select win from sc, (select avg(shift) as m, stddev_pop(shift) as s from sc) where shift > m + 1.5 * s),
tn as (select win from tr where prev <> y)"""


def _flags(spark, d):
    """Event windows whose mean jumps, and the windows where the majority label changes."""
    e = add_slices(fx.ev(spark, d), fx.micros(), F.col("event_id"))
    p = with_position(e, [], fx.EV_ORDER).withColumn("win", F.floor(F.col("pos") / F.lit(wq.W)))
    w = windows.complete(windows.window_stats(p, [], extra={"v": F.avg("f1")}), wq.W)
    w = materialize(w.select("win", "v", F.when(F.col("n_pos") * 2 > F.col("n"), 1).otherwise(0).alias("y")))
    w = windows.with_preceding(w, [], {"v": "pv", "y": "py"})
    w = w.withColumn("shift", F.abs(F.col("v") - F.col("pv")))
    flagged = at.shift_flags(w.filter("pv is not null")).filter("flag = 1").select("win")
    return flagged, w.filter("py <> y").select("win")


@query("drift_transition_match", f"""with {_MATCH_SQL}
select win, case when exists (select 1 from tn where abs(tn.win - fl.win) <= 3) then 1 else 0 end as matched from fl""")
def drift_transition_match(spark, d):
    flagged, true = _flags(spark, d)
    hit, miss = at.near(flagged, true)
    return hit.withColumn("matched", F.lit(1)).unionByName(miss.withColumn("matched", F.lit(0)))


@query("shift_detector_score", f"""with {_MATCH_SQL},
c as (select (select count(*) from fl where exists (select 1 from tn where abs(tn.win - fl.win) <= 3)) as tp,
             (select count(*) from fl where not exists (select 1 from tn where abs(tn.win - fl.win) <= 3)) as fp,
             (select count(*) from tn where not exists (select 1 from fl where abs(tn.win - fl.win) <= 3)) as fn,
             (select count(*) from tn) as n_true)
select tp, fp, fn, n_true, {r6(frac('tp', 'tp + fp'))} as precision, {r6(frac('tp', 'tp + fn'))} as recall,
       {r6('tp / (tp + fn + n_true + 1e-10)')} as recall_published from c""")
def shift_detector_score(spark, d):
    """Precision and recall of the flags, plus the recall form the published report uses."""
    flagged, true = _flags(spark, d)
    hit, miss = at.near(flagged, true)
    missed = at.near(true, flagged)[1]
    marks = (hit.select(F.lit("tp").alias("k")).unionByName(miss.select(F.lit("fp").alias("k")))
             .unionByName(missed.select(F.lit("fn").alias("k"))).unionByName(true.select(F.lit("true").alias("k"))))
    c = marks.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(n) for k, n in
                    (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("true", "n_true"))])
    tp = F.col("tp")
    return c.withColumns({"precision": F.round(ratio(tp, tp + F.col("fp")), 6),
                          "recall": F.round(ratio(tp, tp + F.col("fn")), 6),
                          "recall_published": F.round(tp / (tp + F.col("fn") + F.col("n_true") + 1e-10), 6)})
