"""Statistics over repeated runs: intervals, paired signed-rank tests, report tables.

A run table has one row per (dataset, method, config, split, seed).  Every step
is a grouped aggregate, join or window over those groups.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemetra.operators.ordering import join_null_safe
from telemetra.functions.numeric import ratio
from telemetra.functions.student import t_quantile

LOWER_IS_BETTER = ("fpr", "inference_latency_ms")
CELL = ["dataset", "method", "config", "split_policy"]
EXACT_LIMIT = 50  # largest sample with an exact null distribution


def unpivot_metrics(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(cell, seed, metric, value) rows; non-finite values become null."""
    long = runs.select(*CELL, "seed", *metrics).unpivot([*CELL, "seed"], list(metrics), "metric", "value")
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return long.withColumn("value", F.when(bad, None).otherwise(F.col("value")))


def t_factors(sizes: DataFrame, level: float = 0.95) -> DataFrame:
    """(n, t): the t quantile of each distinct sample size, one call per size."""
    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return pd.Series([t_quantile((1 + level) / 2, int(k) - 1) if k >= 2 else None for k in n], dtype="float64")

    return sizes.select("n").distinct().withColumn("_t", quantile("n"))


def summarize(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, mean, sample deviation (0 for one value) and 95 % t interval of finite values."""
    s = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    half = F.coalesce(F.col("_t") * F.col("std") / F.sqrt("n"), F.lit(0.0))
    return (s.join(t_factors(s), "n").withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})
            .select(*keys, "n", "mean", "std", "ci_low", "ci_high"))


def summary_wide(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per configuration, five statistics per metric."""
    s = summarize(long, [*CELL, "metric"])
    seeds = long.groupBy(*CELL).agg(F.count_distinct("seed").alias("n_seeds"))
    wide = s.groupBy(*CELL).pivot("metric", list(metrics)).agg(
        *[F.first(c).alias(c) for c in ("mean", "std", "ci_low", "ci_high", "n")])
    return join_null_safe(seeds, wide, CELL)


def paired(long: DataFrame, target: str, baselines: Sequence[str]) -> DataFrame:
    """Target and baseline values of the same dataset, split, metric and seed."""
    k = ["dataset", "split_policy", "metric", "seed"]
    left = long.filter(F.col("method") == target).select(*k, F.col("value").alias("proposed"))
    right = long.filter(F.col("method").isin(list(baselines))).select(
        *k, F.col("method").alias("baseline_method"), F.col("value").alias("baseline"))
    return join_null_safe(left, right, k)


def signed_rank(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wilcoxon W+ with average ranks of |difference|, zeros dropped.

    Also the tie correction sum(t^3 - t) that the normal approximation needs.
    A group holds one row per seed.
    """
    d = pairs.withColumn("diff", F.col("proposed") - F.col("baseline"))
    alln = d.groupBy(*keys).agg(F.count("diff").alias("n"), F.avg("diff").alias("mean_diff"),
                                F.count(F.when(F.col("diff") == 0, 1)).alias("n_zero"),
                                F.max(F.abs("diff")).alias("_max"))
    nz = d.filter(F.col("diff") != 0).withColumn("_abs", F.round(F.abs("diff"), 12))
    tied = nz.groupBy(*keys, "_abs").agg(F.count(F.lit(1)).alias("t"),
                                         F.count(F.when(F.col("diff") > 0, 1)).alias("pos"))
    below = W.partitionBy(*keys).orderBy("_abs").rowsBetween(W.unboundedPreceding, -1)
    ranked = tied.withColumn("rank", F.coalesce(F.sum("t").over(below), F.lit(0)) + (F.col("t") + 1) / 2.0)
    t = F.col("t")
    w = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("pos")).alias("w_plus"),
                                  F.sum(t * t * t - t).alias("ties"))
    out = join_null_safe(alln, w, keys, "left")
    return out.withColumns({
        "w_plus": F.when(F.col("_max") <= 1e-8, 0.0).otherwise(F.coalesce("w_plus", F.lit(0.0))),
        "ties": F.coalesce("ties", F.lit(0)), "all_zero": F.col("_max") <= 1e-8,
        "alternative": F.when(F.col("metric").isin(*LOWER_IS_BETTER), "less").otherwise("greater"),
    }).drop("_max")


def null_counts(n: Column) -> Column:
    """Number of subsets of ranks 1..n by their sum, as an array (exact null of W+)."""
    top = F.sequence(F.lit(0), F.floor(n * (n + 1) / 2).cast("int"))
    start = F.transform(top, lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def add(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda v, s: v + F.when(s >= k, F.get(acc, s - k)).otherwise(0.0))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, add)).otherwise(F.array(F.lit(1.0)))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal by its odd-factorial series; 0 or 1 beyond 9 deviations."""
    a = F.least(F.abs(z), F.lit(9.0))
    def add(acc: Column, k: Column) -> Column:
        t = acc["t"] * a * a / (2 * k + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(a.alias("t"), a.alias("s")), add)["s"]
    above = F.lit(0.5) - F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * s
    return F.when(z >= 0, above).otherwise(1 - above)


def p_values(tests: DataFrame) -> DataFrame:
    """One-sided p: exact without ties and zeros up to 50 pairs, normal otherwise."""
    m = (F.col("n") - F.col("n_zero")).cast("int")
    exact = (m <= EXACT_LIMIT) & (F.col("ties") == 0) & (F.col("n_zero") == 0)
    # the null of small samples only: a constant keeps the array short elsewhere
    counts = null_counts(F.when(exact, m).otherwise(0))
    w = F.col("w_plus").cast("int")
    size = F.size("_c")
    part = F.when(F.col("alternative") == "greater", F.slice("_c", w + 1, F.greatest(size - w, F.lit(0)))) \
            .otherwise(F.slice("_c", F.lit(1), w + 1))
    p_exact = F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), m)
    md = m.cast("double")
    var = md * (md + 1) * (2 * md + 1) / 24 - F.col("ties") / 48
    z = ratio(F.col("w_plus") - md * (md + 1) / 4, F.sqrt(F.greatest(var, F.lit(0.0))))

    signed = F.when(F.col("alternative") == "greater", z).otherwise(-z)
    return (tests.withColumn("_c", counts).withColumn("_pn", upper_tail(signed))
            .withColumn("p_value", F.when(F.col("all_zero"), 1.0).when(exact, p_exact).otherwise(F.col("_pn")))
            .withColumn("exact", exact).drop("_c", "_pn"))


def bonferroni(tests: DataFrame, family: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Adjust within each family and mark significance."""
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    adj = F.least(F.lit(1.0), F.col("p_value") * F.col("m_tests"))
    p = F.col("p_adj")
    mark = (F.when(p.isNull() | F.isnan(p), "n/a").when(p < 0.001, "***").when(p < 0.01, "**")
            .when(p < alpha, "*").otherwise("ns"))
    return tests.withColumn("m_tests", m).withColumn("p_adj", adj).withColumn("marker", mark)


def fixed(col: Column, digits: int = 4) -> Column:
    """Decimal text with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", F.round(col, digits))


def mean_pm_std(mean: Column, std: Column, digits: int = 4) -> Column:
    text = F.concat(fixed(mean, digits), F.lit(" ± "), fixed(F.coalesce(std, F.lit(0.0)), digits))
    return F.coalesce(text, F.lit("n/a"))


def interval(lo: Column, hi: Column, n: Column, digits: int = 4) -> Column:
    text = F.concat(F.lit("["), fixed(lo, digits), F.lit(", "), fixed(hi, digits), F.lit("]"))
    return F.when(n >= 2, F.coalesce(text, F.lit("n/a"))).otherwise("n/a")


def parse_seeds(spec: Column) -> Column:
    """'1-20,42' -> ordered distinct seeds; a reversed range is an error."""
    parts = F.transform(F.split(spec, ","), lambda s: F.split(F.trim(s), "-"))

    def expand(p: Column) -> Column:
        a = p[0].cast("int")
        b = F.when(F.size(p) > 1, p[1].cast("int")).otherwise(a)
        bad = F.raise_error(F.concat(F.lit("invalid seed range "), F.array_join(p, "-"))).cast("array<int>")
        return F.when(b < a, bad).otherwise(F.sequence(a, F.greatest(a, b)))

    return F.array_distinct(F.flatten(F.transform(parts, expand)))


def job_plan(seeds: DataFrame, datasets: Sequence[str], configs: Sequence[tuple[str, str]],
             split_policy: str, done: DataFrame) -> DataFrame:
    """Jobs still to run: seeds x datasets x configurations without a stored result."""
    jobs = (seeds.select("seed", F.explode(F.array(*[F.lit(x) for x in datasets])).alias("dataset"))
            .select("*", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(c).alias("config"))
                                            for m, c in configs])))
            .withColumn("split_policy", F.lit(split_policy)))
    keys = [*CELL, "seed"]
    return jobs.select(*keys).join(done.select(*keys), keys, "left_anti")


