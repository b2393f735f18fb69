"""Class balancing: undersampling, oversampling, weights, neighbour interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemetra.functions.seeded import shuffle_key
from telemetra.operators.splits import class_sizes, shuffled_positions


def _two(sizes: dict[int, int]) -> tuple[int, int]:
    """(minority label, majority label); benign counts as majority on a tie."""
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    return (1, 0) if n0 >= n1 else (0, 1)


def undersample(df: DataFrame, ratio: float, key: Column, seed: int, label: str = "label") -> DataFrame:
    """Keep every minority row and about ratio times as many majority rows.

    Which class is the majority follows from the data.  The kept rows are the
    first of a seeded shuffle.  Counts of the digests' leading digits tell in which
    bin the last kept row lies, and only that bin is ordered: no row is shuffled.
    """
    return undersampled(df, ratio, key, seed, label)[0]


def undersampled(df: DataFrame, ratio: float, key: Column, seed: int, label: str = "label") -> tuple[DataFrame, dict[int, int]]:
    """The rows of ``undersample`` and how many there are of each class."""
    sizes = class_sizes(df, label)
    minority, majority = _two(sizes)
    kept = undersampled_sizes(sizes, ratio)
    keep = kept[majority]
    major = df.filter(F.col(label) == majority)
    if keep < sizes.get(majority, 0):
        # a bin holds about 250,000 rows at most
        major = first_of_shuffle(major, shuffle_key(seed, key), keep, 3 if sizes[majority] < 10 ** 9 else 4)
    return df.filter(F.col(label) == minority).unionByName(major), kept


def undersampled_sizes(sizes: dict[int, int], ratio: float) -> dict[int, int]:
    """How many rows of each class ``undersample`` keeps."""
    minority, majority = _two(sizes)
    n = sizes.get(minority, 0)
    return {minority: n, majority: min(sizes.get(majority, 0), round(n * ratio))}


def first_of_shuffle(df: DataFrame, digest: Column, keep: int, digits: int = 3) -> DataFrame:
    """The ``keep`` rows of the smallest digests; ``df`` has more than that."""
    if keep <= 0:
        return df.limit(0)
    head = F.substring(digest, 1, digits)
    bins = df.groupBy(head.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()      # 16 ** digits at most
    before, last = 0, None
    for b, n in sorted((r["b"], r["n"]) for r in bins):
        if before + n >= keep:
            last = b
            break
        before += n
    # the digests of the bin, equal ones counted, in order up to the last kept row
    inside = df.filter(head == last).groupBy(digest.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    rest = keep - before
    up_to = inside.orderBy("h").limit(rest).withColumn("run", run).filter(F.col("run") >= rest)
    cut = up_to.agg(F.min(F.struct("run", "h", "n")).alias("w")).first()["w"]
    if cut["run"] == rest:
        return df.filter(digest <= cut["h"])
    # rows of one digest stand on both sides of the cut
    return df.filter(digest < cut["h"]).unionByName(df.filter(digest == cut["h"]).limit(rest - cut["run"] + cut["n"]))


def oversample(df: DataFrame, key: Column, seed: int, label: str = "label") -> DataFrame:
    """Repeat minority rows until the classes are equal; column ``copy`` numbers the repeats.

    Every minority row appears floor(majority / minority) times and the first
    rows of a seeded shuffle once more.
    """
    sizes = class_sizes(df, label)
    minority, majority = _two(sizes)
    n, m = sizes.get(minority, 0), sizes.get(majority, 0)
    if not n:
        return df.withColumn("copy", F.lit(0))
    times, rest = divmod(m, n)
    minor = shuffled_positions(df.filter(F.col(label) == minority), [], key, seed, rows=n)
    copies = F.lit(times) + F.when(F.col("rk") < rest, 1).otherwise(0)
    repeated = minor.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("rk")
    return df.filter(F.col(label) == majority).withColumn("copy", F.lit(0)).unionByName(repeated)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes * n_class); a single class weighs 1."""
    sizes = class_sizes(df, label)
    n, k = sum(sizes.values()), len(sizes)
    w = F.lit(1.0) if k < 2 else F.lit(float(n)) / (F.lit(k) * F.col("n"))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", w)


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive; 1 without positives."""
    pos, n = F.sum(label), F.count(F.lit(1))
    return df.agg(F.when(pos > 0, (n - pos).cast("double") / pos).otherwise(1.0).alias("pos_weight"))
