"""Choice of decision thresholds.

A grid search never multiplies rows by thresholds.  Each row gets the number of
grid points at or below its score by arithmetic; counts per (group, number) are
combined on the map side, and at most ``size + 1`` buckets per group remain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemetra.operators.ordering import join_null_safe
from telemetra.functions.numeric import ratio
from telemetra.operators.metrics import curve_of, curve_totals, score_counts

EPS = 1e-12


@dataclass(frozen=True)
class Grid:
    """Thresholds start, start + step, ..., optionally rounded to ``digits``."""

    start: float = 0.01
    step: float = 0.01
    size: int = 99
    digits: int | None = None

    def at(self, i: Column) -> Column:
        t = F.lit(self.start) + i * F.lit(self.step)
        return F.round(t, self.digits) if self.digits is not None else t

    def count_at_or_below(self, p: Column) -> Column:
        guess = F.floor((p - F.lit(self.start)) / F.lit(self.step))
        n = (guess + 1 + F.when(self.at(guess + 1) <= p, 1).otherwise(0)
             - F.when(self.at(guess) > p, 1).otherwise(0))
        return F.greatest(F.least(n, F.lit(self.size)), F.lit(0)).cast("int")


WINDOW_GRID = Grid(0.01, 0.01, 99)
FPR_GRID = Grid(0.50, 0.01, 50, digits=10)


def grid_outcomes(df: DataFrame, grid: Grid, keys: Sequence[str] = (), y: str = "y",
                  p: str = "p") -> DataFrame:
    """Distinct outcomes over the grid: thresholds i_lo..i_hi share tp and fp."""
    counts = (df.groupBy(*keys, grid.count_at_or_below(F.col(p)).alias("b"))
              .agg(F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("n")))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    down = part.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, 0)
    c = counts.select(
        *keys, "b", F.sum("pos").over(down).alias("tp"),
        F.sum(F.col("n") - F.col("pos")).over(down).alias("fp"),
        F.sum("pos").over(part).alias("n_pos"), F.sum(F.col("n") - F.col("pos")).over(part).alias("n_neg"),
        F.coalesce(F.lag("b").over(part.orderBy("b")), F.lit(0)).alias("lower"),
        F.max("b").over(part).alias("top"))
    own = F.when(F.col("b") > 0, F.struct(F.col("lower").alias("i_lo"), (F.col("b") - 1).alias("i_hi"),
                                          F.col("tp"), F.col("fp")))
    zero = F.lit(0).cast("long")
    above = F.when((F.col("b") == F.col("top")) & (F.col("top") < grid.size),
                   F.struct(F.col("top").alias("i_lo"), F.lit(grid.size - 1).alias("i_hi"),
                            zero.alias("tp"), zero.alias("fp")))
    return c.select(*keys, "n_pos", "n_neg",
                    F.inline(F.filter(F.array(own, above), lambda s: s.isNotNull())))


def grid_f1(df: DataFrame, grid: Grid = WINDOW_GRID, keys: Sequence[str] = (), y: str = "y",
            p: str = "p") -> DataFrame:
    """F1-optimal grid threshold per key; near-equal F1 prefers the one closest to 0.5."""
    o = grid_outcomes(df, grid, keys, y, p)
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos"))
    # the outcome's own interval holds equal F1 values: take its point nearest to 0.5
    mid = round((0.5 - grid.start) / grid.step)
    i = F.greatest(F.col("i_lo"), F.least(F.lit(mid), F.col("i_hi")))
    o = o.withColumn("f1", f1).withColumn("threshold", grid.at(i))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    best = F.max("f1").over(part)
    tied = o.withColumn("_best", best).filter(
        F.col("_best") - F.col("f1") <= F.lit(1e-8) + F.lit(1e-5) * F.col("_best"))
    pick = F.min_by(F.struct("threshold", "_best", "n_pos", "n_neg"),
                    F.struct(F.round(F.abs(F.col("threshold") - 0.5), 9), F.col("threshold")))
    return tied.groupBy(*keys).agg(pick.alias("_w")).select(
        *keys, F.col("_w.threshold").alias("threshold"), F.col("_w._best").alias("f1"),
        F.col("_w.n_pos").alias("n_pos"), F.col("_w.n_neg").alias("n_neg"))


def f1_at(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from precision and recall with the small constant the exact search uses."""
    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return 2 * prec * rec / (prec + rec + F.lit(EPS))


def exact_f1(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """F1-optimal threshold over all distinct scores; ties go to the lowest."""
    counts = score_counts(df, y, p)
    n_pos, _ = curve_totals(counts)
    c = curve_of(counts)
    f1 = f1_at(F.col("tp"), F.col("fp"), F.lit(n_pos) - F.col("tp"))
    best = c.withColumn("f1", f1).agg(F.max_by(F.struct("p", "f1"), F.struct(F.col("f1"), -F.col("p"))).alias("w"))
    return best.select(F.col("w.p").alias("threshold"), F.col("w.f1").alias("f1"))


def exact_f1_per_window(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Exact search inside each window; a window has a fixed number of rows."""
    per = df.groupBy(*keys, p).agg(F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    part = W.partitionBy(*keys)
    down = part.orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    c = per.select(*keys, F.col(p).alias("threshold"), F.sum("pos").over(down).alias("tp"),
                   F.sum(F.col("n") - F.col("pos")).over(down).alias("fp"),
                   F.sum("pos").over(part).alias("n_pos"), F.sum("n").over(part).alias("n"))
    f1 = f1_at(F.col("tp"), F.col("fp"), F.col("n_pos") - F.col("tp"))
    return (c.withColumn("f1", f1).groupBy(*keys)
            .agg(F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
                 F.first("n_pos").alias("n_pos"), F.first("n").alias("n")))


def fpr_constrained(df: DataFrame, alpha: float = 0.05, grid: Grid = FPR_GRID,
                    objective: str = "f1", y: str = "y", p: str = "p") -> DataFrame:
    """Best threshold with FPR <= alpha: by F1 (default) or recall, then recall, then lower FPR.

    Nothing feasible gives threshold 0.5 with recall 0.
    """
    o = grid_outcomes(df, grid, (), y, p)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "n_pos", "n_neg"))
    o = o.withColumns({"f1": ratio(2 * tp, tp + fp + pos), "recall": ratio(tp, pos), "fpr": ratio(fp, neg),
                       "threshold": grid.at(F.col("i_lo"))})
    order = [F.col("recall") if objective == "recall" else F.round("f1", 8), F.round("recall", 8),
             -F.col("fpr"), -F.col("threshold")]
    best = o.filter(F.col("fpr") <= alpha).agg(
        F.max_by(F.struct("threshold", "f1", "recall", "fpr"), F.struct(*order)).alias("w"))
    return best.select(F.coalesce("w.threshold", F.lit(0.5)).alias("threshold"),
                       *[F.coalesce(f"w.{c}", F.lit(0.0)).alias(c) for c in ("f1", "recall", "fpr")])


def window_thresholds(df: DataFrame, keys: Sequence[str], size: int, keep_partial: bool = True,
                      grid: Grid = WINDOW_GRID) -> tuple[DataFrame, dict]:
    """Grid threshold per window; one-class windows take the global threshold.

    Returns the window table and the global choice (two numbers).
    """
    row = grid_f1(df, grid).first()
    g = row.asDict() if row else {"threshold": 0.5, "f1": 0.0}
    local = grid_f1(df, grid, keys)
    at_global = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(c, 1)).alias(k) for k, c in
          (("tp", (F.col("y") == 1) & (F.col("p") >= g["threshold"])),
           ("fp", (F.col("y") == 0) & (F.col("p") >= g["threshold"])),
           ("fn", (F.col("y") == 1) & (F.col("p") < g["threshold"])))])
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    fallback = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    w = join_null_safe(local, at_global, keys).select(
        *keys, "n", F.when(both, F.col("threshold")).otherwise(F.lit(g["threshold"])).alias("threshold"),
        F.when(both, F.col("f1")).otherwise(fallback).alias("f1"), both.alias("local"))
    return (w if keep_partial else w.filter(F.col("n") == size)), g
