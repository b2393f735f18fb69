"""Correlation graph of windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from telemetra.operators import comoments, thresholds, windows
from telemetra.operators import correlation as co
from telemetra.operators.ordering import with_position
from telemetra.plans.registry import query, r6
from telemetra.session import materialize
from telemetra.sources import fixtures as fx

FEATS = fx.LI_FEATURES
KEYS = ["stream", "block"]
_PAIRS = co.pairs(FEATS)


def corr_sql(feats=FEATS) -> str:
    """Correlation columns as aggregates."""
    return ", ".join(
        f"case when stddev_samp({a}) > 1e-12 and stddev_samp({b}) > 1e-12 "
        f"then covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) else 0.0 end as r_{a}_{b}"
        for a, b in co.pairs(feats))


def frob_sql(feats=FEATS, a: str = "wc", b: str = "base") -> str:
    return "sqrt(2 * (" + " + ".join(f"pow({a}.r_{x}_{y} - {b}.r_{x}_{y}, 2)" for x, y in co.pairs(feats)) + "))"


BASE_SQL = f"base as (select {corr_sql()} from lib where attack = 0 and split = 'train')"
WC_SQL = f"""wc as (select stream, block, win, count(*) as n, sum(attack) as n_pos, min(ts) as start_ts, max(ts) as end_ts,
       {corr_sql()} from liw group by stream, block, win)"""
WD_SQL = f"wd as (select wc.*, case when n >= 2 then {frob_sql()} end as div from wc, base)"


def benign_baseline(spark, d, feats=FEATS):
    x = fx.li_blocks(spark, d).filter((F.col("attack") == 0) & (F.col("split") == "train"))
    return co.baseline(x, feats)


@query("benign_correlation", f"""with {fx.LIB_SQL}, {BASE_SQL}
{' union all '.join(f"select '{a}' as i, '{b}' as j, {r6(f'r_{a}_{b}')} as r from base" for a, b in _PAIRS)}""")
def benign_correlation(spark, d):
    x = fx.li_blocks(spark, d).filter((F.col("attack") == 0) & (F.col("split") == "train"))
    return co.long_form(co.correlations(x, [], FEATS), [], FEATS).select("i", "j", (F.round("r", 6) + 0.0).alias("r"))


@query("window_correlation", f"""with {fx.LIW_SQL}, {WC_SQL}
select stream, block, win, n, {', '.join(f"{r6(f'r_{a}_{b}')} as r_{a}_{b}" for a, b in _PAIRS)} from wc where n >= 2""")
def window_correlation(spark, d):
    w = co.correlations(fx.li_windows(spark, d), [*KEYS, "win"], FEATS).filter("n >= 2")
    return w.select(*KEYS, "win", "n", *[(F.round(co.pair_name(a, b), 6) + 0.0).alias(co.pair_name(a, b))
                                         for a, b in _PAIRS])


@query("window_divergence", f"""with {fx.LIW_SQL}, {BASE_SQL}, {WC_SQL}, {WD_SQL}
select stream, block, win, n, {r6('div')} as divergence from wd where n >= 2""")
def window_divergence(spark, d):
    s = co.window_scores(fx.li_windows(spark, d), KEYS, FEATS, benign_baseline(spark, d))
    return s.filter("n >= 2").select(*KEYS, "win", "n", F.round("divergence", 6).alias("divergence"))


_ROW = ", ".join(fx.LI_KEYS[1:5])


@query("graph_feature", f"""with {fx.LIW_SQL}, {BASE_SQL}, {WC_SQL}, {WD_SQL}
select {', '.join(f'liw.{k}' for k in fx.LI_KEYS[1:5])}, {r6('coalesce(a.div, b.div, 0.0)')} as graph_frob_div from liw
join wd a on a.stream = liw.stream and a.block = liw.block and a.win = liw.win
left join wd b on b.stream = liw.stream and b.block = liw.block and b.win = liw.win - 1""")
def graph_feature(spark, d):
    s = co.row_scores(fx.li_windows(spark, d), KEYS, FEATS, benign_baseline(spark, d))
    return s.select(*fx.LI_KEYS[1:5], F.round("graph_frob_div", 6).alias("graph_frob_div"))


_GLOBAL_SQL = f"""{fx.LIB_SQL}, base as (select {corr_sql()} from lib where attack = 0),
g as (select *, (row_number() over (order by {', '.join(fx.LI_KEYS)}, stream) - 1) // {fx.LI_WINDOW} as win from lib),
wc as (select win, count(*) as n, {corr_sql()} from g group by win),
wd as (select win, {frob_sql()} as div from wc, base where n = {fx.LI_WINDOW})"""


@query("graph_feature_global", f"""with {_GLOBAL_SQL}
select {', '.join(f'g.{k}' for k in fx.LI_KEYS[1:5])}, {r6('coalesce(a.div, b.div)')} as graph_frob_div from g
left join wd a on a.win = g.win left join wd b on b.win = g.win - 1""")
def graph_feature_global(spark, d):
    """Windows over the whole table by position; the remainder takes the last full window."""
    x = fx.li_blocks(spark, d)
    base = co.baseline(x.filter("attack = 0"), FEATS)
    g = with_position(fx.li_sliced(x), [], [*fx.LI_KEYS, "stream"]).withColumn(
        "win", F.floor(F.col("pos") / F.lit(fx.LI_WINDOW)))
    w = windows.carry_values(co.window_scores(g, [], FEATS, base), [], fx.LI_WINDOW, "divergence")
    return g.join(w, "win", "left").select(*fx.LI_KEYS[1:5], F.round("divergence", 6).alias("graph_frob_div"))


@query("correlation_edges", f"""with {fx.LIW_SQL}, {WC_SQL}, e as (
{' union all '.join(f"select stream, block, win, '{a}' as i, '{b}' as j, r_{a}_{b} as r from wc where n >= 2" for a, b in _PAIRS)})
select stream, block, win, i, j, {r6('r')} as r from e where abs(r) >= 0.6""")
def correlation_edges(spark, d):
    w = co.correlations(fx.li_windows(spark, d), [*KEYS, "win"], FEATS).filter("n >= 2")
    return co.edges(w, [*KEYS, "win"], FEATS).withColumn("r", F.round("r", 6))


_ABS = [f"abs(r_{a}_{b})" for a, b in _PAIRS]


@query("edge_density", f"""with {fx.LIW_SQL}, {WC_SQL}
select stream, block, win, {r6('(' + ' + '.join(f'case when {a} >= 0.6 then 1.0 else 0.0 end' for a in _ABS) + f') / {len(_ABS)}')} as density,
       {r6('(' + ' + '.join(_ABS) + f') / {len(_ABS)}')} as mean_abs_r from wc where n >= 2""")
def edge_density(spark, d):
    w = co.correlations(fx.li_windows(spark, d), [*KEYS, "win"], FEATS).filter("n >= 2")
    dens, mean = co.density(FEATS)
    return w.select(*KEYS, "win", F.round(dens, 6).alias("density"), F.round(mean, 6).alias("mean_abs_r"))


@query("divergence_detector", f"""with {fx.LIW_SQL}, {BASE_SQL}, {WC_SQL}, {WD_SQL}, scored as (
  select liw.attack as y, round(coalesce(a.div, b.div, 0.0), 6) as p from liw
  join wd a on a.stream = liw.stream and a.block = liw.block and a.win = liw.win
  left join wd b on b.stream = liw.stream and b.block = liw.block and b.win = liw.win - 1),
cv as (select p, cast(sum(sum(y)) over (order by p desc) as bigint) as tp,
              cast(sum(count(*) - sum(y)) over (order by p desc) as bigint) as fp, sum(sum(y)) over () as np from scored group by p),
f as (select p, tp / cast(tp + fp as double) as pr, tp / cast(np as double) as re from cv)
select p as threshold, {r6('2 * pr * re / (pr + re + 1e-12)')} as f1 from f
order by case when pr + re > 0 then 2 * pr * re / (pr + re + 1e-12) else 0.0 end desc, p limit 1""")
def divergence_detector(spark, d):
    """The divergence itself as a detector: best-F1 threshold over its values."""
    s = co.row_scores(fx.li_windows(spark, d), KEYS, FEATS, benign_baseline(spark, d))
    s = s.select(F.col("attack").alias("y"), F.round("graph_frob_div", 6).alias("p"))
    return thresholds.exact_f1(s).withColumn("f1", F.round("f1", 6))


@query("wide_window_divergence", """with p as (
  select *, (row_number() over (order by vec_id) - 1) // 50 as win from embeddings),
e as (select vec_id, win, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from p),
bp as (select a.i, b.i as j, corr(a.x, b.x) as r from e a join e b on a.vec_id = b.vec_id and a.i < b.i
       where a.label <> 0 group by all),
wp as (select a.win, a.i, b.i as j, corr(a.x, b.x) as r from e a join e b on a.vec_id = b.vec_id and a.i < b.i group by all),
n as (select win, count(*) as n from p group by win)
select win, max(n) as n, (round(sqrt(2 * sum(pow(wp.r - bp.r, 2))), 4) + 0.0) as divergence
from wp join bp using (i, j) join n using (win) group by win""")
def wide_window_divergence(spark, d):
    """64-dimensional windows against the baseline of the vectors whose label is not 0."""
    e = fx.emb(spark, d)
    base = co.wide_baseline(e.filter("label <> 0"), "embedding", 64)
    return co.wide_window_scores(e, "embedding", base).withColumn("divergence", F.round("divergence", 4))


@query("wide_correlation", f"""with p as (
  select *, (row_number() over (order by vec_id) - 1) // 50 as win from embeddings),
e as (select vec_id, win, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from p)
select a.win, cast(a.i as int) as i, cast(b.i as int) as j,
       {r6('case when stddev_samp(a.x) > 1e-12 and stddev_samp(b.x) > 1e-12 then corr(a.x, b.x) else 0.0 end')} as r
from e a join e b on a.vec_id = b.vec_id and a.i < b.i group by a.win, a.i, b.i having count(*) >= 2""")
def wide_correlation(spark, d):
    """The 2,016 correlations of 64 columns in every window of vectors."""
    r = comoments.correlations(fx.emb(spark, d), ["win"], F.col("embedding"), 64).filter("n >= 2")
    return comoments.long_form(r, ["win"], list(range(64))).withColumn("r", F.round("r", 6) + 0.0)


#: Columns of the wide shipment view: residues of sums of its keys, so that both engines agree to the bit.
_WIDE = {f"g{k}": f"(l_orderkey * {3 * k + 1} + l_partkey * {5 * k + 2} + l_suppkey * {k * k + 7} + l_linenumber * {11 * k + 3}) % {17 + 6 * k}"
         for k in range(38)}
_WIDE_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def wide_values(order, line, part, supp) -> np.ndarray:
    """The columns of ``_WIDE`` for arrays of the keys."""
    k = np.arange(len(_WIDE), dtype=np.int64)
    o, n, p, s = (np.asarray(x, np.int64)[:, None] for x in (order, line, part, supp))
    return np.fmod(o * (3 * k + 1) + p * (5 * k + 2) + s * (k * k + 7) + n * (11 * k + 3), 17 + 6 * k).astype(float)


@query("wide_graph_feature", f"""with {fx.LIW_SQL}, v as (
  select *, {', '.join(f'cast({e} as double) as {k}' for k, e in _WIDE.items())} from liw),
base as (select {corr_sql(list(_WIDE))} from v where attack = 0 and split = 'train'),
wc as (select stream, block, win, count(*) as n, {corr_sql(list(_WIDE))} from v group by stream, block, win),
sc as (select stream, block, win, n, case when n >= 2 then {frob_sql(list(_WIDE))} end as div from wc, base),
t as (select a.*, coalesce(a.div, b.div, 0.0) as score from sc a
      left join sc b on b.stream = a.stream and b.block = a.block and b.win = a.win - 1)
select {_WIDE_KEYS}, {r6('score')} as graph_frob_div from v join t using (stream, block, win)""")
def wide_graph_feature(spark, d):
    """Divergence of 38 columns per window, on every row."""
    row = _WIDE_KEYS.split(", ")
    # stored without the wide columns: four passes read it, and a window's rows stand together
    x = materialize(fx.li_windows(spark, d).select(*KEYS, "win", "attack", "split", *row))
    values = comoments.Derived(row, wide_values)
    base = comoments.baseline(x.filter("attack = 0 and split = 'train'"), values, len(_WIDE))
    return co.wide_row_scores(x, KEYS, values, base, size=fx.LI_WINDOW).select(
        *row, F.round("graph_frob_div", 6).alias("graph_frob_div"))
