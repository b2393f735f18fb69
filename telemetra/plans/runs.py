"""Statistics and report tables over repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.functions.student import t_quantile
from telemetra.operators import runstats as rs
from telemetra.plans.registry import query, r6
from telemetra.session import materialize
from telemetra.sources import fixtures as fx
from telemetra.sources import tables

M = fx.METRICS
HEADLINE = [("base", "B0"), ("extension", "E1"), ("proposed", "P6")]
ABLATIONS = [f"P{i}" for i in range(8)]
_CELL = "dataset, method, config, split_policy"
_TVALS = "tq(df, t) as (values " + ", ".join(f"({k}, cast({t_quantile(0.975, k)!r} as double))" for k in range(1, 61)) + ")"
_LONG = "long as (unpivot (select dataset, method, config, split_policy, seed, " + ", ".join(M) + \
    " from runs) on " + ", ".join(M) + " into name metric value value)"
_SUM = f"""sm as (select {_CELL}, metric, count(value) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std
  from long group by {_CELL}, metric),
su as (select sm.*, mean - coalesce(t * std / sqrt(n), 0) as ci_low, mean + coalesce(t * std / sqrt(n), 0) as ci_high
  from sm left join tq on df = n - 1)"""
_SU_SQL = f"{fx.RUNS_SQL}, {_LONG}, {_TVALS}, {_SUM}"


def runs(spark, d):
    """The de-duplicated run table, stored once: every report reads it several times."""
    return materialize(tables.latest_runs(fx.runs_raw(spark, d)))


def long_runs(spark, d):
    return rs.unpivot_metrics(runs(spark, d), M)


@query("dedupe_runs", f"with {fx.RUNS_SQL} select {_CELL}, seed, f1, recall, load_order from runs")
def dedupe_runs(spark, d):
    return tables.latest_runs(fx.runs_raw(spark, d)).select(*rs.CELL, "seed", "f1", "recall", "load_order")


@query("latest_result", f"""with {fx.RUNS_SQL}
select dataset, method, arg_max(config, seed + 100 * load_order) as config, max(seed) filter (load_order = 2) as seed,
       arg_max(f1, seed + 100 * load_order) as f1 from runs_raw group by dataset, method""")
def latest_result(spark, d):
    last = F.max_by(F.struct("config", "seed", "f1"), F.struct("load_order", "seed")).alias("w")
    return fx.runs_raw(spark, d).groupBy("dataset", "method").agg(last).select("dataset", "method", "w.*")


@query("paired_runs", f"""with {fx.RUNS_SQL}
select a.dataset, a.seed, a.f1 as proposed, b.f1 as baseline from runs a join runs b using (dataset, split_policy, seed)
where a.method = 'proposed' and b.method = 'base'""")
def paired_runs(spark, d):
    p = rs.paired(long_runs(spark, d).filter("metric = 'f1'"), "proposed", ["base"])
    return p.select("dataset", "seed", "proposed", "baseline")


@query("run_summary_ci", f"""with {_SU_SQL}
select {_CELL}, n, {r6('mean', 5)} as mean, {r6('std', 5)} as std, {r6('ci_low', 5)} as ci_low, {r6('ci_high', 5)} as ci_high
from su where metric = 'f1'""")
def run_summary_ci(spark, d):
    s = rs.summarize(long_runs(spark, d).filter("metric = 'f1'"), rs.CELL)
    return s.select(*rs.CELL, "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])


_STATS = ("mean", "std", "ci_low", "ci_high")


@query("config_summary", f"""with {_SU_SQL}
select {_CELL}, (select count(distinct seed) from runs r where r.dataset = su.dataset and r.method = su.method) as n_seeds,
{', '.join(f"{r6(f'''max({s}) filter (metric = '{m}')''', 5)} as {m}_{s}" for m in M for s in _STATS)},
{', '.join(f"max(n) filter (metric = '{m}') as {m}_n" for m in M)} from su group by {_CELL}""")
def config_summary(spark, d):
    w = rs.summary_wide(long_runs(spark, d), M)
    return w.select(*rs.CELL, "n_seeds", *[F.round(f"{m}_{s}", 5).alias(f"{m}_{s}") for m in M for s in _STATS],
                    *[f"{m}_n" for m in M])


_PAIR = f"""pr as (select a.dataset, a.metric, b.method as baseline_method, a.seed, a.value - b.value as diff
  from long a join long b using (dataset, split_policy, metric, seed) where a.method = 'proposed' and b.method <> 'proposed'),
al as (select dataset, metric, baseline_method, count(*) as n, avg(diff) as mean_diff, count(*) filter (diff = 0) as n_zero,
              max(abs(diff)) as largest
  from pr group by all),
rk as (select *, rank() over w + (count(*) over (partition by dataset, metric, baseline_method, round(abs(diff), 12)) - 1) / 2.0 as rnk,
              count(*) over (partition by dataset, metric, baseline_method, round(abs(diff), 12)) as t
       from pr where diff <> 0 window w as (partition by dataset, metric, baseline_method order by round(abs(diff), 12))),
wp as (select dataset, metric, baseline_method, cast(coalesce(sum(rnk) filter (diff > 0), 0) as double) as w_plus,
              cast(sum(t * t - 1) as bigint) as ties from rk group by all),
ts as (select al.*, case when largest <= 1e-8 then 0.0 else coalesce(w_plus, 0.0) end as w_plus, coalesce(ties, 0) as ties, case when metric in ('fpr', 'inference_latency_ms') then 'less' else 'greater' end as alternative
       from al left join wp using (dataset, metric, baseline_method)),
-- subsets of ranks 1..n by sum, one rank at a time
nul(n, s, c) as (select 0, 0, cast(1 as double)
  union all select n + 1, s2, sum(c) from (
    select n, s as s2, c from nul where n < 20 union all select n, s + n + 1, c from nul where n < 20) group by n, s2),
pz as (select ts.*, n - n_zero as m, (case alternative when 'greater' then 1 else -1 end) * (w_plus - (n - n_zero) * (n - n_zero + 1) / 4.0)
         / sqrt((n - n_zero) * (n - n_zero + 1) * (2 * (n - n_zero) + 1) / 24.0 - ties / 48.0) as z from ts),
pt as (select pz.*, 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda k:
         exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))) as above from pz),
pv as (select pt.*, case when largest <= 1e-8 then 1.0
         when ties = 0 and n_zero = 0 then (
           select sum(case when (alternative = 'greater' and s >= w_plus) or (alternative = 'less' and s <= w_plus) then c else 0 end)
           from nul where nul.n = pt.n) / pow(2.0, n)
         when z >= 0 then above else 1 - above end as p_value from pt)"""
_PV_SQL = f"with recursive {fx.RUNS_SQL}, {_LONG}, {_PAIR}"


def tests(spark, d):
    p = rs.paired(long_runs(spark, d), "proposed", ["base", "extension"])
    return rs.p_values(rs.signed_rank(p, ["dataset", "metric", "baseline_method"]))


@query("wilcoxon_signed_rank", f"""{_PV_SQL}
select dataset, metric, baseline_method, n, n_zero, ties, alternative, w_plus, {r6('mean_diff', 5)} as mean_diff from pv""")
def wilcoxon_signed_rank(spark, d):
    return tests(spark, d).select("dataset", "metric", "baseline_method", "n", "n_zero", "ties", "alternative", "w_plus",
                                  (F.round("mean_diff", 5) + 0.0).alias("mean_diff"))


@query("wilcoxon_p_values", f"""{_PV_SQL}
select dataset, metric, baseline_method, {r6('p_value')} as p_value from pv""")
def wilcoxon_p_values(spark, d):
    """Exact p values without ties and zeros, else the normal approximation."""
    return tests(spark, d).select("dataset", "metric", "baseline_method", F.round("p_value", 6).alias("p_value"))


_ADJ = """ad as (select *, count(*) over (partition by dataset) as m_tests,
  least(1.0, p_value * count(*) over (partition by dataset)) as p_adj from pv)"""
_MARK = "case when p_adj < 0.001 then '***' when p_adj < 0.01 then '**' when p_adj < 0.05 then '*' else 'ns' end"


def adjusted(spark, d):
    """The family is all tests of a dataset."""
    return rs.bonferroni(tests(spark, d), ["dataset"])


@query("planned_comparisons", f"""{_PV_SQL}, {_ADJ}
select dataset, metric, baseline_method, m_tests, {r6('p_adj')} as p_adj, {_MARK} as marker from ad""")
def planned_comparisons(spark, d):
    return adjusted(spark, d).select("dataset", "metric", "baseline_method", "m_tests", F.round("p_adj", 6).alias("p_adj"), "marker")


def _fx(e: str) -> str:
    return f"printf('%.4f', round({e}, 4))"


@query("formatted_summary", f"""with {_SU_SQL}
select dataset, method, config, metric, {_fx('mean')} || ' ± ' || {_fx('std')} as value,
       case when n >= 2 then '[' || {_fx('ci_low')} || ', ' || {_fx('ci_high')} || ']' else 'n/a' end as ci from su""")
def formatted_summary(spark, d):
    s = rs.summarize(long_runs(spark, d), [*rs.CELL, "metric"])
    return s.select("dataset", "method", "config", "metric", rs.mean_pm_std(F.col("mean"), F.col("std")).alias("value"),
                    rs.interval(F.col("ci_low"), F.col("ci_high"), F.col("n")).alias("ci"))


@query("comparison_table", f"""{_PV_SQL}, {_ADJ}, sm as (select dataset, method, metric, avg(value) as mean, stddev_samp(value) as std from long group by all),
c as (select dataset, metric, {', '.join(f"max({_fx('mean')} || ' ± ' || {_fx('std')}) filter (method = '{m}') as {m}" for m, _ in HEADLINE)}
      from sm group by dataset, metric),
k as (select dataset, metric, max({_MARK}) filter (baseline_method = 'base') as vs_base,
             max({_MARK}) filter (baseline_method = 'extension') as vs_extension from ad group by dataset, metric)
select c.*, coalesce(vs_base, 'n/a') as vs_base, coalesce(vs_extension, 'n/a') as vs_extension from c left join k using (dataset, metric)""")
def comparison_table(spark, d):
    """Metric rows, one column per method, and a significance mark per baseline."""
    long = long_runs(spark, d)
    s = rs.summarize(long, [*rs.CELL, "metric"])
    cells = (s.withColumn("cell", rs.mean_pm_std(F.col("mean"), F.col("std")))
             .groupBy("dataset", "metric").pivot("method", [m for m, _ in HEADLINE]).agg(F.first("cell")))
    marks = (adjusted(spark, d).groupBy("dataset", "metric").pivot("baseline_method", ["base", "extension"])
             .agg(F.first("marker")).toDF("dataset", "metric", "vs_base", "vs_extension"))
    return cells.join(marks, ["dataset", "metric"], "left").na.fill("n/a", ["vs_base", "vs_extension"])


@query("seed_coverage", f"""with {fx.RUNS_SQL}, c as (select dataset, method, config, count(distinct seed) as n_seeds from runs group by all),
w as (select d.dataset, h.method, h.config from (values ('ds1'), ('ds2'), ('ds3')) d(dataset),
      (values {', '.join(f"('{m}', '{c}')" for m, c in HEADLINE)}) h(method, config))
select w.*, coalesce(n_seeds, 0) as n_seeds from w left join c using (dataset, method, config) where coalesce(n_seeds, 0) < 20""")
def seed_coverage(spark, d):
    """Headline cells with fewer than 20 seeds."""
    want = spark.createDataFrame([(x, m, c) for x in ("ds1", "ds2", "ds3") for m, c in HEADLINE],
                                 "dataset string, method string, config string")
    have = fx.runs_raw(spark, d).groupBy("dataset", "method", "config").agg(F.count_distinct("seed").alias("n_seeds"))
    return want.join(have, ["dataset", "method", "config"], "left").na.fill(0, ["n_seeds"]).filter("n_seeds < 20")


@query("method_matrix", f"""with {fx.RUNS_SQL}, l as (select method, dataset, arg_max(f1, seed) as f1, arg_max(fpr, seed) as fpr from runs group by all)
select method, {', '.join(f"coalesce(max({_fx(m)}) filter (dataset = '{x}'), 'TBD') as {x}_{m}" for x in ('ds1', 'ds2', 'ds3') for m in ('f1', 'fpr'))}
from l group by method""")
def method_matrix(spark, d):
    last = runs(spark, d).groupBy("method", "dataset").agg(
        F.max_by(F.struct("f1", "fpr"), F.col("seed")).alias("w")).select(
        "method", "dataset", rs.fixed(F.col("w.f1")).alias("f1"), rs.fixed(F.col("w.fpr")).alias("fpr"))
    names = ["ds1", "ds2", "ds3"]
    wide = last.groupBy("method").pivot("dataset", names).agg(F.first("f1").alias("f1"), F.first("fpr").alias("fpr"))
    return wide.na.fill("TBD")


@query("ablation_table", f"""with {_SU_SQL}, a as (select unnest([{', '.join(f"'{c}'" for c in ABLATIONS)}]) as config)
select a.config, {', '.join(f"coalesce(max({_fx('mean')} || ' ± ' || {_fx('std')}) filter (metric = '{m}'), 'n/a') as {m}" for m in ('f1', 'fpr', 'precision', 'recall'))},
       coalesce(max(n), 0) as n from a left join su on su.config = a.config and su.dataset = 'ds1' group by a.config""")
def ablation_table(spark, d):
    s = rs.summarize(long_runs(spark, d).filter("dataset = 'ds1'"), ["config", "metric"])
    cols = ["f1", "fpr", "precision", "recall"]
    wide = (s.withColumn("cell", rs.mean_pm_std(F.col("mean"), F.col("std"))).groupBy("config")
            .pivot("metric", cols).agg(F.first("cell")))
    n = s.groupBy("config").agg(F.max("n").alias("n"))
    plan = spark.createDataFrame([(c,) for c in ABLATIONS], "config string")
    return plan.join(wide, "config", "left").join(n, "config", "left").na.fill("n/a", cols).na.fill(0, ["n"])


#: Published targets of the base method.
TARGETS = [("accuracy", 0.996), ("f1", 0.97), ("recall", 0.93)]


@query("target_gap", f"""with {fx.RUNS_SQL}, {_LONG}, t as (select * from (values {', '.join(f"('{m}', cast({v} as double))" for m, v in TARGETS)}) v(metric, target))
select dataset, metric, target, {r6('avg(value)', 5)} as observed, {r6('avg(value) - target', 5)} as gap from long join t using (metric)
where method = 'base' group by dataset, metric, target""")
def target_gap(spark, d):
    t = spark.createDataFrame(TARGETS, "metric string, target double")
    obs = long_runs(spark, d).filter("method = 'base'").groupBy("dataset", "metric").agg(F.avg("value").alias("v"))
    return obs.join(F.broadcast(t), "metric").select("dataset", "metric", "target", F.round("v", 5).alias("observed"),
                                        (F.round(F.col("v") - F.col("target"), 5) + 0.0).alias("gap"))


@query("best_trial", f"""with {fx.RUNS_SQL}
select dataset, method, seed, f1 from (select *, row_number() over (partition by dataset, method order by f1 desc, seed) as rn from runs) where rn = 1""")
def best_trial(spark, d):
    """Highest validation F1 per cell; the first trial wins a tie."""
    w = F.max_by(F.struct("seed", "f1"), F.struct(F.col("f1"), -F.col("seed"))).alias("w")
    return runs(spark, d).groupBy("dataset", "method").agg(w).select("dataset", "method", "w.seed", "w.f1")


@query("results_by_role", f"""with {fx.RUNS_SQL}
select dataset, method, case when seed <= 10 then 'primary' else 'secondary' end as role, count(*) as n, {r6('avg(f1)', 5)} as f1 from runs group by all""")
def results_by_role(spark, d):
    """Block-split results and unseen-attack results are never averaged together."""
    policy = F.when(F.col("seed") <= 10, "block").otherwise("scenario")
    role = F.when(policy == "block", "primary").otherwise("secondary")
    return runs(spark, d).groupBy("dataset", "method", role.alias("role")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 5).alias("f1"))


@query("parse_seed_spec", """with s as (select event_type, min(user_id) as a, max(user_id) as b from events group by 1)
select event_type, unnest(list_sort(list_distinct(list_concat(range(a, a + 6), [b])))) as seed from s""")
def parse_seed_spec(spark, d):
    """'a-b,c,d' expanded in order without repeats; the text is built from the device ids."""
    s = fx.table(spark, d, "events").groupBy("event_type").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b"))
    spec = F.format_string("%d-%d, %d,%d", F.col("a"), F.col("a") + 5, F.col("b"), F.col("a"))
    return s.select("event_type", F.explode(rs.parse_seeds(spec).cast("array<bigint>")).alias("seed"))


@query("seed_job_plan", f"""with {fx.RUNS_SQL}, s as (select unnest(list_concat(range(1, 21), [42])) as seed),
c as (select * from (values {', '.join(f"('{m}', '{c}')" for m, c in [*HEADLINE, *[('proposed', a) for a in ABLATIONS if a != 'P6']])}) v(method, config)),
j as (select d.dataset, c.method, c.config, 'standard' as split_policy, cast(s.seed as integer) as seed from s, c, (values ('ds1'), ('ds2')) d(dataset))
select j.* from j anti join runs using (dataset, method, config, split_policy, seed)""")
def seed_job_plan(spark, d):
    """Jobs without a stored result, for the headline methods and the ablations."""
    done = tables.latest_runs(fx.runs_raw(spark, d))
    seeds = spark.range(1).select(F.explode(rs.parse_seeds(F.lit("1-20,42"))).alias("seed"))
    configs = [*HEADLINE, *[("proposed", a) for a in ABLATIONS if a != "P6"]]
    return rs.job_plan(seeds, ["ds1", "ds2"], configs, "standard", done)
