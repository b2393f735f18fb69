"""Tree classifiers, distillation and tree attributions on Spark ML."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.numeric import clip
from telemetra.operators.balance import undersampled
from telemetra.operators.splits import class_sizes
from telemetra.session import file_by_file, shared_path


@dataclass(frozen=True)
class TreeConfig:
    """Published settings of the boosted trees."""

    depth: int = 6
    step: float = 0.1
    trees: int = 2000
    subsample: float = 0.8
    patience: int = 50       # rounds without a lower validation loss after which boosting stops
    seed: int = 42


BASE_TREES = TreeConfig()
EXTENSION_TREES = TreeConfig(step=0.05, trees=1000)
#: Majority per minority row tried when the ratio is tuned.
RATIOS = (1.0, 2.0, 5.0, 10.0)


def small(config: TreeConfig, trees: int = 6, depth: int = 3) -> TreeConfig:
    """A short run of the same recipe."""
    return replace(config, trees=trees, depth=depth)


#: Rows of a partition that a fit holds in memory, and of a file of the tables it reads.
FIT_ROWS = 250_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """Partitions of a bounded number of rows for a fit, which reads them many times and keeps them in memory.

    The partitions of a scan follow file sizes, of which a fit's own form is many times as large.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FIT_ROWS)))


@contextmanager
def fit_table(df: DataFrame, rows: int) -> Iterator[DataFrame]:
    """The rows of a fit in partitions of at most ``FIT_ROWS``; ``df`` selects from a table stored in files of that size.

    With a file or more for each core the files are read one by one and no row moves.  Fewer rows are dealt,
    once: the plans of a fit (training, validation) would each deal them anew, so they stay on disk while it lasts.
    """
    if rows >= FIT_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        with file_by_file(df.sparkSession):
            yield df
        return
    kept = dealt(df, rows).persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_trees(df: DataFrame, features: Sequence[str], config: TreeConfig, ratio: float | None,
              row_key: Column, label: str = "label") -> GBTClassificationModel:
    """Boosted trees on the train rows, stopped early on the validation rows.

    ``ratio`` undersamples the majority class of the *training* rows; positives
    then weigh the remaining class ratio.  Other splits are never resampled.
    """
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    if ratio is not None:
        train, n = undersampled(train, ratio, row_key, config.seed, label)
    else:
        n = class_sizes(train, label)
    w = n.get(0, 0) / n[1] if n.get(1) else 1.0
    rows = train.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(w))).otherwise(1.0))
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=config.depth, stepSize=config.step,
                        subsamplingRate=config.subsample, seed=config.seed)
    with fit_table(rows.select(label, "weight", *features), sum(n.values())) as kept:
        # the weight steers the trees; the loss that stops them counts each validation row once
        return boosted(gbt, assemble(kept, features), assemble(val.select(label, F.lit(1.0).alias("weight"), *features), features), config)


def boosted(gbt: GBTClassifier, train: DataFrame, val: DataFrame, config: TreeConfig) -> GBTClassificationModel:
    """The trees up to the lowest validation loss, when boosting stops after ``patience`` rounds without a lower one.

    Spark ML's own stop waits for no later round, so runs without it are made.  A round depends on those before it
    and the seed alone: a longer run begins with the trees of a shorter one, and runs double until one is long enough.
    Without validation rows all trees stay.
    """
    rounds = config.trees if val.isEmpty() else min(3 * config.patience, config.trees)
    while True:
        m = gbt.copy({gbt.maxIter: rounds}).fit(train)
        best, stopped = best_round(m.evaluateEachIteration(val), config.patience)
        if stopped or rounds == config.trees:
            return first_trees(m, best + 1)
        rounds = min(2 * rounds, config.trees)


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round of the lowest loss before boosting stops, and whether it stops within the rounds given."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model that boosting had made after ``n`` rounds."""
    if n == model.getNumTrees:
        return model
    sc = SparkContext._active_spark_context
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._jvm.double, n)
    for i, (t, w) in enumerate(zip(model._java_obj.trees()[:n], model.treeWeights)):
        trees[i], weights[i] = t, w
    made = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        model.uid, trees, weights, model.numFeatures, model.numClasses)
    return model._copyValues(GBTClassificationModel(made))


def score(model: GBTClassificationModel, df: DataFrame, features: Sequence[str], out: str = "p") -> DataFrame:
    if compact(model):
        trees = tree_tables(model, df.sparkSession)
        margin = reduce(operator.add, [walk(t, features, lambda n, t=t: F.lit(float(t["w"] * t["pred"][n]))) for t in trees])
        return df.withColumn(out, present(features, 1.0 / (1.0 + F.exp(-2.0 * margin))))
    s = model.transform(assemble(df, features))
    return s.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


# --- distillation -------------------------------------------------------------

def soft_target(teacher: Column, label: Column | None, teacher_weight: float = 0.7,
                label_weight: float = 0.3) -> Column:
    """Weighted mean of teacher probability and label; without labels the teacher alone."""
    if label is None:
        return teacher
    total = teacher_weight + label_weight
    return teacher * F.lit(teacher_weight / total) + label * F.lit(label_weight / total)


def fit_student(df: DataFrame, features: Sequence[str], target: str, depth: int = 4, seed: int = 42):
    """A shallow regression tree that imitates the soft target."""
    tree = DecisionTreeRegressor(featuresCol="features", labelCol=target, maxDepth=depth, seed=seed)
    with fit_table(df.select(target, *features), df.count()) as kept:
        return tree.fit(assemble(kept, features))


def student_score(student, df: DataFrame, features: Sequence[str], out: str = "student_p") -> DataFrame:
    if compact(student):
        t = tree_tables(student, df.sparkSession)[0]
        value = walk(t, features, lambda n: F.lit(float(t["pred"][n])))
        return df.withColumn(out, present(features, clip(value, 0.0, 1.0)))
    s = student.transform(assemble(df, features))
    return s.withColumn(out, clip(F.col("prediction"), 0.0, 1.0)).drop("features", "prediction")


def distillation_losses(df: DataFrame, student: str, teacher: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(student) - F.col(teacher), 2)).alias("teacher_loss"),
                  F.avg(F.pow(F.col(student) - F.col(label), 2)).alias("label_loss"))


# --- small models as columns --------------------------------------------------

#: Nodes of a model that is written as column expressions; larger ones are left to Spark ML and numpy.
COMPACT_NODES = 500


def compact(model) -> bool:
    """Whether the model is small enough to be evaluated as columns, so that its results need not be stored."""
    return (model.totalNumNodes if hasattr(model, "totalNumNodes") else model.numNodes) <= COMPACT_NODES


def walk(t: dict[str, np.ndarray], features: Sequence[str], at_leaf: Callable[[int], Column], node: int = 0) -> Column:
    """What ``at_leaf`` gives for the leaf that a row reaches."""
    if t["left"][node] < 0:
        return at_leaf(node)
    left, right = (walk(t, features, at_leaf, int(t[side][node])) for side in ("left", "right"))
    x = F.col(features[t["feature"][node]]).cast("double")
    return F.when(x <= F.lit(float(t["threshold"][node])), left).otherwise(right)


def present(features: Sequence[str], value: Column) -> Column:
    """The value; a row with a missing feature is an error, as it is for the vectors of Spark ML."""
    missing = reduce(operator.or_, [F.col(f).isNull() | F.isnan(F.col(f).cast("double")) for f in features])
    return F.when(missing, F.raise_error(F.lit("a feature is null or NaN"))).otherwise(value)


# --- tree attributions --------------------------------------------------------

#: Node arrays of the models that are in use.
_TABLES: WeakKeyDictionary = WeakKeyDictionary()


def tree_tables(model, spark) -> list[dict[str, np.ndarray]]:
    """Node arrays per tree, read from the saved model (its size is that of the model) once.

    ``model`` is a boosted classifier or a single regression tree.
    """
    if model not in _TABLES:
        _TABLES[model] = _read_trees(model, spark)
    return _TABLES[model]


def _read_trees(model, spark) -> list[dict[str, np.ndarray]]:
    path = shared_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    alone = "nodeData" not in data.columns
    at = "" if alone else "nodeData."
    nodes = data.select(
        (F.lit(0) if alone else F.col("treeID")).alias("treeID"), f"{at}id", f"{at}prediction", f"{at}leftChild", f"{at}rightChild",
        F.col(f"{at}split.featureIndex").alias("feature"),
        F.get(f"{at}split.leftCategoriesOrThreshold", 0).alias("threshold")).toPandas()
    out = []
    for i, w in enumerate([1.0] if alone else model.treeWeights):
        t = nodes[nodes["treeID"] == i].sort_values("id")
        out.append({"w": np.float64(w), "pred": t["prediction"].to_numpy(float), "left": t["leftChild"].to_numpy(int),
                    "right": t["rightChild"].to_numpy(int), "feature": t["feature"].to_numpy(int),
                    "threshold": t["threshold"].fillna(0.0).to_numpy(float)})
    return out


def tree_importance(model: GBTClassificationModel, df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, n, imp_ per feature): mean absolute attribution of the fitted trees, summed map-side."""
    if compact(model):
        trees, names = tree_tables(model, df.sparkSession), list(features)
        # the leaf tells the path, and the path the attributions
        leaf = df.select(*keys, *[present(names, walk(t, names, F.lit)).alias(f"_leaf{i}") for i, t in enumerate(trees)])
        given = [path_attributions(t, len(names)) for t in trees]
        return leaf.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
            F.avg(F.abs(reduce(operator.add, [F.get(F.lit(g[:, j].tolist()), F.col(f"_leaf{i}")) for i, g in enumerate(given)])))
            .alias(f"imp_{f}") for j, f in enumerate(names)])
    a = tree_attribution(model, df, features, list(keys) or df.columns[:1])
    return a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(F.col(f"a_{f}"))).alias(f"imp_{f}") for f in features])


def path_attributions(t: dict[str, np.ndarray], width: int) -> np.ndarray:
    """Per node the weighted attribution of each feature on the way from the root."""
    out = np.zeros((len(t["left"]), width))
    open_nodes = [0]
    while open_nodes:
        n = open_nodes.pop()
        if t["left"][n] >= 0:
            for child in (int(t["left"][n]), int(t["right"][n])):
                out[child] = out[n]
                out[child, t["feature"][n]] += t["w"] * (t["pred"][child] - t["pred"][n])
                open_nodes.append(child)
    return out


def tree_attribution(model: GBTClassificationModel, df: DataFrame, features: Sequence[str],
                     keep: Sequence[str]) -> DataFrame:
    """Path attributions: the change of a node's value is credited to the feature split on.

    ``bias`` plus all attributions equals the model's margin for every row.
    The trees travel in the task closure; rows stay where they are.
    """
    trees = tree_tables(model, df.sparkSession)
    bias = float(sum(t["w"] * t["pred"][0] for t in trees))
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[names].to_numpy(float)
            out = np.zeros_like(x)
            rows = np.arange(len(x))
            for t in trees:
                node = np.zeros(len(x), dtype=int)
                live = t["left"][node] >= 0
                while live.any():
                    r, n = rows[live], node[live]
                    f = t["feature"][n]
                    nxt = np.where(x[r, f] <= t["threshold"][n], t["left"][n], t["right"][n])
                    np.add.at(out, (r, f), t["w"] * (t["pred"][nxt] - t["pred"][n]))
                    node[live] = nxt
                    live = t["left"][node] >= 0
            yield pd.DataFrame({**{k: b[k] for k in keep}, **{f"a_{n}": out[:, i] for i, n in enumerate(names)},
                                "bias": bias, "margin": out.sum(axis=1) + bias})

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    body = ", ".join(f"a_{n} double" for n in names)
    cols = list(dict.fromkeys([*keep, *names]))
    keep = [f.name for f in df.schema.fields if f.name in keep]
    return df.select(*cols).mapInPandas(run, f"{head}, {body}, bias double, margin double")
