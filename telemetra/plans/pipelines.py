"""The three detection pipelines as sequences of Spark stages.

Row-level stages are lazy plans over one stored feature table; what the driver
keeps between stages is a baseline, a threshold and a few counters.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.operators import attribution as at
from telemetra.operators import correlation as co
from telemetra.operators import balance, cleaning, features, metrics, models, online, thresholds, windows
from telemetra.operators import replay as rp
from telemetra.operators.ordering import add_slices, join_null_safe, range_slices, with_position, with_running_sum
from telemetra.operators.splits import class_sizes
from telemetra.session import materialize, shared_path
from telemetra.sources import tables


@dataclass(frozen=True)
class Stages:
    """Which parts of the proposed method an ablation switches on."""

    ewma: bool = True
    cusum: bool = True
    constrained: bool = True
    drift: bool = True
    distill: bool = True
    student_only: bool = False


ABLATIONS = {
    "P0": Stages(False, False, False, False, False),
    "P1": Stages(True, False, False, False, False),
    "P2": Stages(True, True, False, False, False),
    "P3": Stages(True, True, True, False, False),
    "P4": Stages(True, True, True, True, False),
    "P5": Stages(True, True, True, True, True),
    "P6": Stages(True, True, True, True, True),
    "P7": Stages(True, True, True, True, True, student_only=True),
}


@dataclass(frozen=True)
class Source:
    """A windowed feature table: keys (stream, block, win), split, label and features.

    It is stored in files of at most ``models.FIT_ROWS`` rows, which a fit reads one by one.
    """

    rows: DataFrame
    features: Sequence[str]
    row_key: Sequence[str]
    window: int

    @property
    def key(self) -> Column:
        return F.concat_ws("|", *self.row_key)


KEYS = ["stream", "block"]


def prepare_table(df: DataFrame, keep: Sequence[str], train: str = "train") -> tuple[DataFrame, dict]:
    """Raw columns to model features: consolidate, impute, filter by variance, scale.

    Fitted on the rows whose ``split`` is ``train``.  The result is stored with
    one directory per split, next to a manifest of what was fitted.
    """
    spark = df.sparkSession
    flat = features.consolidate(df)
    cols = features.numeric_features(flat.schema, exclude=keep)
    flat = materialize(flat.select(*keep, *cols))
    fit = F.col("split") == train
    medians = cleaning.medians(flat, cols, fit)
    full = cleaning.impute(flat.select(*keep, *cols), medians, empty=0.0)
    kept = cleaning.varying(full, cols, fit)
    moments = cleaning.fit_moments(full, kept, fit)
    scaled = cleaning.scale(full.select(*keep, *kept), moments)
    path = shared_path(spark, "prepared")
    tables.write_split_store(scaled, path)
    manifest = {"features": kept, "dropped": [c for c in cols if c not in kept],
                "medians": {c: (0.0 if v is None else v) for c, v in medians.items()},
                "scale": {c: {"mean": m, "std": v} for c, (m, v) in moments.items()}, "train": train}
    doc = spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value"))
    doc.coalesce(1).write.text(f"{path}-manifest")
    stored = spark.read.schema(scaled.schema).parquet(path)
    return stored, manifest


def baseline_of(src: Source) -> dict[str, float]:
    """Correlations of the benign training rows."""
    return co.baseline(src.rows.filter("split = 'train' and label = 0"), src.features)


def with_divergence(src: Source) -> tuple[Source, dict[str, float]]:
    """Append the distance of each row's window from the benign training baseline."""
    base = baseline_of(src)
    rows = co.row_scores(src.rows, KEYS, src.features, base)
    return Source(materialize(rows, models.FIT_ROWS), [*src.features, "graph_frob_div"], src.row_key, src.window), base


def result(scored: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """One row of test metrics at a threshold."""
    t = scored.filter("split = 'test'").select(F.col("label").alias("y"), F.col(p).alias("p"))
    t = materialize(t.withColumn("pred", F.when(F.col("p") >= threshold, 1).otherwise(0)))
    auc = metrics.roc_auc(t).first()["roc_auc"]
    return metrics.with_rates(metrics.confusion_counts(t)).withColumns(
        {"roc_auc": F.round(F.lit(auc), 6), "threshold": F.lit(float(threshold))})


def val_pairs(scored: DataFrame) -> DataFrame:
    return scored.filter("split = 'val'").select(F.col("label").alias("y"), "p", *KEYS, "win")


def base_method(src: Source, config: models.TreeConfig, ratio: float = 1.0) -> tuple[DataFrame, DataFrame, float, object]:
    """Undersampled boosted trees: all rows with their score, the stored validation pairs, their F1-optimal threshold, the model."""
    m = models.fit_trees(src.rows, src.features, config, ratio, src.key)
    scored = models.score(m, src.rows, src.features)
    v = materialize(val_pairs(scored).select("y", "p"))
    return scored, v, thresholds.exact_f1(v).first()["threshold"], m


def tune_ratio(src: Source, config: models.TreeConfig, ratios: Sequence[float]) -> DataFrame:
    """Validation F1, training rows and trees per undersampling ratio; the first best ratio is the choice."""
    out, sizes = [], class_sizes(src.rows.filter("split = 'train'"), "label")
    for r in ratios:
        _, v, tau, m = base_method(src, config, r)
        v = v.withColumn("pred", F.when(F.col("p") >= tau, 1).otherwise(0))
        row = metrics.with_rates(metrics.confusion_counts(v)).first()
        n = balance.undersampled_sizes(sizes, r)
        out.append((float(r), float(tau), row["f1"], row["precision"], row["recall"], n.get(0, 0), n.get(1, 0), m.getNumTrees))
    spark = src.rows.sparkSession
    df = spark.createDataFrame(out, "ratio double, threshold double, val_f1 double, val_precision double, val_recall double, "
                                    "n_benign long, n_attack long, n_trees int")
    best = max(out, key=lambda t: t[2])[0]
    return df.withColumn("chosen", F.col("ratio") == F.lit(best))


def extension_model(src: Source, config: models.TreeConfig) -> tuple[Source, object, DataFrame]:
    """Source with the divergence feature, trees on it, and all rows with their score."""
    ext, _ = with_divergence(src)
    m = models.fit_trees(ext.rows, ext.features, config, None, ext.key)
    return ext, m, models.score(m, ext.rows, ext.features)


def stored_scores(model, scored: DataFrame) -> DataFrame:
    """Scores that are read several times: stored, unless columns of a small model give them with each scan."""
    return scored if models.compact(model) else materialize(scored)


def extension_method(src: Source, config: models.TreeConfig) -> dict:
    """Divergence feature, trees, window thresholds on validation, cyclic use on test."""
    ext, m, scored = extension_model(src, config)
    scored = stored_scores(m, scored)
    learned, g = thresholds.window_thresholds(val_pairs(scored), [*KEYS, "win"], src.window)
    order = learned.select(*KEYS, "win", "threshold")
    slots = numbered(order)
    n = slots.count()
    test = scored.filter("split = 'test'")
    tw = numbered(test.select(*KEYS, "win").distinct()).withColumn("slot", F.pmod("ord", F.lit(n)))
    tw = tw.join(slots.select(F.col("ord").alias("slot"), "threshold"), "slot").select(*KEYS, "win", "threshold")
    pred = join_null_safe(test, tw, [*KEYS, "win"]).select(
        F.col("label").alias("y"), "p", F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0).alias("pred"))
    return {"model": m, "source": ext, "scored": scored, "thresholds": learned, "global": g, "pred": pred,
            "drift": attribution_drift(m, scored, ext.features, src.window)}


def numbered(df: DataFrame) -> DataFrame:
    """Global number of each window in (stream, block, win) order."""
    per = df.groupBy("stream", "block").agg(F.count(F.lit(1)).alias("n"))
    run = with_running_sum(range_slices(per, "stream", "block"), [], [F.col("stream"), F.col("block")], {"_run": F.col("n")})
    first = run.select("stream", "block", (F.col("_run") - F.col("n")).alias("_first"))
    return join_null_safe(df, first, ["stream", "block"]).withColumn("ord", F.col("_first") + F.col("win")).drop("_first")


DRIFT = "graph_frob_div"


def replay(src: Source, scored: DataFrame, base: dict[str, float], names_in: Sequence[str], tau: float, trees: Sequence[rp.Tree],
           features_in: Sequence[str], link=rp.boosted_probability, alpha: float = 0.05) -> DataFrame:
    """Guarded baseline replay of the validation windows.

    Each window's divergence from the adapted baseline is the drift feature of its rows; the model's predictions on
    these drive the gate.  Returns stream, block, win, ord and the trail.
    """
    names = [co.pair_name(a, b) for a, b in co.pairs(names_in)]
    start = [base[k] for k in names]

    def matrices(df: DataFrame, benign: Column | None = None) -> DataFrame:
        w = co.correlations(df, [*KEYS, "win"], names_in, extra={"benign_fraction": F.avg(benign)} if benign is not None else None)
        w = materialize(w.select(*KEYS, "win", "n", *(["benign_fraction"] if benign is not None else []), F.array(*names).alias("r")))
        # windows of a split are renumbered without gaps inside their stream
        order = add_slices(w, F.col("block"), F.col("win"))
        return with_position(order, ["stream"], [F.col("block"), F.col("win")], "ord").drop("_slice")

    fit = matrices(scored.filter("split = 'train'"), F.when(F.col("label") == 0, 1.0).otherwise(0.0))
    ok = fit.filter("benign_fraction >= 0.9 and n >= 2").select("stream", F.col("ord").alias("t"), "r")
    ok = with_position(add_slices(ok, F.col("t")), ["stream"], [F.col("t")], "k").drop("_slice")
    det = online.calibrate(online.benign_scores(ok, ["stream"], "k", start, alpha), "divergence", allow_empty=True)
    rows = scored.filter("split = 'val'")
    shares, cuts = rp.interval_shares(rows, [*KEYS, "win"], trees, features_in, DRIFT, tau, link) if DRIFT in features_in else (None, None)
    val = materialize(join_null_safe(matrices(rows), shares, [*KEYS, "win"]))
    trail = rp.feedback_replay(val, ["stream"], "ord", start, det, cuts, alpha)
    return join_null_safe(val.select(*KEYS, "win", "ord"), trail, ["stream", "ord"])


def attribution_drift(model, rows: DataFrame, names: Sequence[str], size: int, nan_tau: float = 1.0) -> DataFrame:
    """Tau of each complete validation window's attribution ranks against those of the training rows, by the fitted trees."""
    names = list(names)
    ref = at.ranks_of(models.tree_importance(model, rows.filter("split = 'train'"), [], names).first(), names)
    w = models.tree_importance(model, rows.filter("split = 'val'"), [*KEYS, "win"], names)
    return at.tau_vs_reference(at.with_ranks(windows.complete(w, size), names), names, ref, nan_tau=nan_tau)


def proposed_method(src: Source, config: models.TreeConfig, stages: Stages = Stages(), done: dict | None = None) -> dict:
    """Baseline, trees, constrained threshold, attribution reference, guarded replay, student.

    ``done`` keeps what the stages give under the switches they depend on; runs of one source and
    configuration that share it, compute each of them once.
    """
    done = {} if done is None else done

    def once(name: str, make, *switches):
        if (name, *switches) not in done:
            done[name, *switches] = make()
        return done[name, *switches]

    def fitted() -> tuple:
        ext, base = with_divergence(src) if stages.ewma else (src, None)
        m = models.fit_trees(ext.rows, ext.features, config, None, ext.key)
        return ext, base, m, stored_scores(m, models.score(m, ext.rows, ext.features))

    ext, base, m, scored = once("fit", fitted, stages.ewma)
    tau = 0.5
    if stages.constrained:
        tau = once("threshold", lambda: thresholds.fpr_constrained(val_pairs(scored)).first()["threshold"], stages.ewma)
    out = {"model": m, "scored": scored, "threshold": tau, "events": None, "updates": None, "student": None,
           "losses": None, "drift": None}
    if stages.drift:
        out["drift"] = once("drift", lambda: materialize(attribution_drift(m, scored, ext.features, src.window, nan_tau=0.0)), stages.ewma)
    if stages.cusum and base is not None:
        def replayed() -> tuple[int, int]:
            trees = models.tree_tables(m, scored.sparkSession)
            r = replay(src, scored, base, list(src.features), tau, trees, ext.features).agg(
                F.sum("alarm").alias("a"), F.sum("updated").alias("u")).first()
            return int(r["a"] or 0), int(r["u"] or 0)

        out["events"], out["updates"] = once("replay", replayed, stages.ewma, tau)
    if stages.distill:
        def distilled() -> dict:
            soft = scored.withColumn("target", models.soft_target(F.col("p"), F.col("label")))
            student = models.fit_student(soft.filter("split = 'train'"), list(ext.features), "target")
            both = stored_scores(student, models.student_score(student, scored, list(ext.features)))
            return {"student_trees": models.tree_tables(student, scored.sparkSession), "student_model": student, "student": both,
                    "losses": materialize(models.distillation_losses(both.filter("split = 'train'"), "student_p", "p", "label"))}

        out |= once("student", distilled, stages.ewma)
    return out
