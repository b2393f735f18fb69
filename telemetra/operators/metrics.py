"""Detection metrics as aggregates: one pass, and no global sort of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.numeric import count_where, ratio, rnd
from telemetra.operators.ordering import add_slices, with_running_sum
from telemetra.session import materialize


def confusion(y: Column, pred: Column) -> dict[str, Column]:
    return {"tp": count_where((y == 1) & (pred == 1)), "fp": count_where((y == 0) & (pred == 1)),
            "fn": count_where((y == 1) & (pred == 0)), "tn": count_where((y == 0) & (pred == 0))}


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred",
                     keys: Sequence[str] = ()) -> DataFrame:
    c = confusion(F.col(y), F.col(pred))
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in c.items()])


def derived() -> dict[str, Column]:
    """All rates that follow from tp, fp, fn, tn; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    f1, f1_0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1,
        "fpr": ratio(fp, fp + tn),
        "precision_0": ratio(tn, tn + fn), "recall_0": ratio(tn, tn + fp), "f1_0": f1_0,
        "accuracy": ratio(tp + tn, n),
        "weighted_f1": ratio(f1 * (tp + fn) + f1_0 * (tn + fp), n),
    }


def with_rates(counts: DataFrame, names: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    d = derived()
    return counts.withColumns({k: rnd(d[k], digits) for k in (names or d)})


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Positives and negatives per distinct score, stored once.

    Equal scores are combined on the map side.  Everything a curve needs is read
    from this table, so the pipeline behind ``df`` runs a single time.
    """
    per = df.groupBy(F.col(p).alias("p")).agg(F.sum(y).cast("long").alias("pos"),
                                              F.count(F.lit(1)).alias("n"))
    return materialize(per.select("p", "pos", (F.col("n") - F.col("pos")).alias("neg")))


def score_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per distinct score: its positives and negatives, and tp / fp when it is the threshold.

    The scores are cut into ordered slices; only per-slice totals are ordered globally.
    """
    return curve_of(score_counts(df, y, p))


def curve_of(counts: DataFrame) -> DataFrame:
    return with_running_sum(add_slices(counts, -F.col("p")), [], [F.desc("p")],
                            {"tp": F.col("pos"), "fp": F.col("neg")}) \
        .select("p", "pos", "neg", "tp", "fp")


def curve_totals(counts: DataFrame) -> tuple[int, int]:
    r = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return int(r["p"] or 0), int(r["n"] or 0)


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Tie-aware area under the ROC curve; 0.5 when only one class is present."""
    c = score_curve(df, y, p)
    above = F.col("tp") - F.col("pos")
    pairs = F.sum(F.col("neg").cast("double") * (above + F.col("pos") / 2.0))
    np_, nn = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return c.agg(ratio(pairs, np_ * nn, 0.5).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    c = score_curve(df, y, p)
    step = F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return c.agg(ratio(F.sum(step), F.sum("pos")).alias("average_precision"))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro and weighted rows."""
    d = derived()
    c = confusion_counts(df, y, pred).withColumns(d)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(F.lit(name).alias("row"), rnd(p).alias("precision"), rnd(r).alias("recall"),
                        rnd(f).alias("f1"), s.alias("support"))

    def macro(k: str) -> Column:
        return (F.col(k) + F.col(f"{k}_0")) / 2.0

    def weighted(k: str) -> Column:
        return ratio(F.col(k) * s1 + F.col(f"{k}_0") * s0, n)

    acc = F.col("accuracy")
    rows = F.array(row("0", F.col("precision_0"), F.col("recall_0"), F.col("f1_0"), s0),
                   row("1", F.col("precision"), F.col("recall"), F.col("f1"), s1),
                   row("accuracy", acc, acc, acc, n),
                   row("macro avg", macro("precision"), macro("recall"), macro("f1"), n),
                   row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), n))
    return c.select(F.inline(rows))


def window_fpr(windows: DataFrame) -> DataFrame:
    """Mean, population variance and maximum of the windows' FPR.

    ``windows`` has fp, tn and threshold per window.  A window without
    negatives counts as 0.0 and is reported in ``n_without_negatives``.
    """
    f = ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    z = F.lit(0.0)
    return windows.withColumn("_fpr", f).agg(
        F.count(F.lit(1)).alias("n_windows"),
        rnd(F.coalesce(F.avg("_fpr"), z)).alias("fpr_mean"),
        rnd(F.coalesce(F.var_pop("_fpr"), z)).alias("fpr_var"),
        rnd(F.coalesce(F.max("_fpr"), z)).alias("fpr_max"),
        rnd(F.coalesce(F.stddev_pop("threshold"), z)).alias("threshold_std"),
        count_where(F.col("fp") + F.col("tn") == 0).alias("n_without_negatives"))
