"""Dealing rows, blocks, devices or windows into train / validation / test."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.numeric import half_even
from telemetra.functions.seeded import shuffle_key, shuffle_slice, slice_digits
from telemetra.operators.ordering import join_null_safe, with_position
from telemetra.session import materialize


@dataclass(frozen=True)
class SplitPolicy:
    """How a table is divided.  ``strategy`` is block, random, temporal or group."""

    strategy: str = "block"
    test: float = 0.2
    val: float = 0.1
    seed: int = 42
    stratify: bool = True
    refit_scaler: bool = True
    block_minutes: int = 20

    def as_dict(self) -> dict:
        return asdict(self)

    @property
    def val_of_train(self) -> float:
        return self.val / (1 - self.test)


#: The three policies the experiments use.
REFERENCE = SplitPolicy("random", 0.2, 0.0, refit_scaler=False)
BASE_REFERENCE = SplitPolicy("random", 0.2, 0.1, refit_scaler=False)
PROJECT_STANDARD = SplitPolicy("block", 0.2, 0.1, refit_scaler=True)

#: Shares of blocks when whole blocks are dealt per scenario.
SCENARIO_BLOCK_SHARES = {"train": 0.60, "val": 0.15}


def block_stats(df: DataFrame, block: Sequence[str], label: str = "label") -> DataFrame:
    """Rows and positives per block: one map-side combined aggregate."""
    return df.groupBy(*block).agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.sum(label).cast("long").alias("n_pos"))


def stratum(n_rows: Column, n_pos: Column) -> Column:
    """0 benign, 1 mixed, 2 attack only."""
    return F.when(n_pos == 0, 0).when(n_pos == n_rows, 2).otherwise(1)


def _deal(blocks: DataFrame, strata: list[str], key: Column, seed: int) -> DataFrame:
    """Shuffled rank of each block in its stratum, and the stratum's size.

    Blocks of a few rows can be as many as a hundredth of the data, and one
    stratum may hold most of them: the rank is cut by hash slices as well.
    """
    blocks = materialize(blocks)
    sizes = blocks.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    ranked = shuffled_positions(blocks, strata, key, seed, "_rk", blocks.count())
    return join_null_safe(ranked, sizes, strata)


def deal_blocks(df: DataFrame, policy: SplitPolicy, block: str = "block",
                label: str = "label") -> DataFrame:
    """(block, stratum, split): whole blocks, stratified by their attack content."""
    stats = block_stats(df, [block], label).withColumn(
        "stratum", stratum(F.col("n_rows"), F.col("n_pos")))
    d = _deal(stats, ["stratum"], F.col(block), policy.seed)
    n = F.col("_n")
    n_test = (F.when(n >= 3, F.least(F.greatest(F.lit(1), half_even(n * policy.test)), n - 2))
              .when(n == 2, 1).otherwise(0))
    d = d.withColumn("_t", n_test)
    n_val = F.lit(0)
    if policy.val > 0:
        n_val = F.when(n >= 3, F.least(F.greatest(F.lit(1), half_even(n * policy.val)),
                                       n - F.col("_t") - 1)).otherwise(0)
    rk = F.col("_rk")
    side = (F.when(rk < F.col("_t"), "test").when(rk < F.col("_t") + n_val, "val")
            .otherwise("train"))
    return d.select(block, "n_rows", "n_pos", "stratum", side.alias("split"))


def deal_scenario_blocks(df: DataFrame, seed: int, scenario: str = "scenario",
                         block: str = "block", label: str = "label") -> DataFrame:
    """(scenario, block, split): strata are scenario x majority label."""
    stats = block_stats(df, [scenario, block], label).withColumn(
        "attacked", F.when(F.col("n_pos") * 2 >= F.col("n_rows"), 1).otherwise(0))
    d = _deal(stats, [scenario, "attacked"], F.col(block), seed)
    n, rk = F.col("_n"), F.col("_rk")
    n_train = F.when(n >= 3, F.least(F.greatest(
        F.lit(1), half_even(n * SCENARIO_BLOCK_SHARES["train"])), n - 2)).otherwise(1)
    d = d.withColumn("_t", n_train)
    n_val = F.when(n >= 3, F.least(F.greatest(
        F.lit(1), half_even(n * SCENARIO_BLOCK_SHARES["val"])), n - F.col("_t") - 1)).otherwise(0)
    side = (F.when(rk < F.col("_t"), "train").when(rk < F.col("_t") + n_val, "val")
            .otherwise("test"))
    return d.select(scenario, block, "n_rows", "n_pos", "attacked", side.alias("split"))


def shuffled_positions(df: DataFrame, group: list[str], key: Column, seed: int,
                       name: str = "rk", rows: int | None = None) -> DataFrame:
    """Position in a seeded shuffle of each group; a hot class is cut by hash slices."""
    h = df.withColumn("_h", shuffle_key(seed, key))
    h = h.withColumn("_slice", shuffle_slice(F.col("_h"), slice_digits(rows)))
    return with_position(h, group, ["_h"], name).drop("_h", "_slice")


def class_sizes(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class: the classes are a handful of labels."""
    return {r[label]: r["n"] for r in
            df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def by_class(label: str, values: dict[int, int], default: int = 0) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col(label) == k, F.lit(v)).otherwise(out)
    return out


def split_random(df: DataFrame, policy: SplitPolicy, key: Column, label: str = "label") -> DataFrame:
    """Exact stratified shares per class, unlike ``randomSplit`` or ``sampleBy``."""
    sizes = class_sizes(df, label)
    test = {c: round(n * policy.test) for c, n in sizes.items()}
    val = {c: round(n * policy.val) for c, n in sizes.items()}
    d = shuffled_positions(df, [label], key, policy.seed, rows=sum(sizes.values()))
    t, v = by_class(label, test), by_class(label, val)
    return d.withColumn("split", F.when(F.col("rk") < t, "test")
                        .when(F.col("rk") < t + v, "val").otherwise("train")).drop("rk")


def temporal_cuts(n: int, policy: SplitPolicy) -> tuple[int, int]:
    """(end of train, end of validation) as global positions."""
    fit = round(n * (1 - policy.test))
    return (round(fit * (1 - policy.val_of_train)) if policy.val > 0 else fit), fit


def split_temporal(df: DataFrame, policy: SplitPolicy, order: Sequence[str]) -> DataFrame:
    """Oldest rows train, newest test.  ``df`` carries order slices."""
    train_end, val_end = temporal_cuts(df.count(), policy)
    d = with_position(df, [], order, "_g")
    return d.withColumn("split", F.when(F.col("_g") < train_end, "train")
                        .when(F.col("_g") < val_end, "val").otherwise("test")).drop("_g")


def deal_groups(df: DataFrame, policy: SplitPolicy, group: str) -> DataFrame:
    """(group, split): no device appears in two splits."""
    ids = materialize(df.select(group).distinct())
    n = ids.count()
    n_test = -int(-n * policy.test // 1)
    n_val = -int(-(n - n_test) * policy.val_of_train // 1) if policy.val > 0 else 0
    d = shuffled_positions(ids, [], F.col(group), policy.seed, rows=n)
    return d.select(group, F.when(F.col("rk") < n_test, "test")
                    .when(F.col("rk") < n_test + n_val, "val").otherwise("train").alias("split"))


def attach(df: DataFrame, assignment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the split to the rows; adaptive execution broadcasts a small table."""
    return join_null_safe(df, assignment.select(*keys, "split"), keys)


def assign_scenarios(df: DataFrame, sides: dict[str, str], scenario: str = "scenario") -> DataFrame:
    """Whole scenarios by dictionary; a scenario without an entry is an error."""
    present = {r[0] for r in df.select(scenario).distinct().limit(len(sides) + 1).collect()}
    missing = sorted(present - set(sides))
    if missing:
        raise KeyError(f"scenarios not covered: {missing}")
    side = F.create_map(*[F.lit(x) for kv in sides.items() for x in kv])
    return df.withColumn("split", side[F.col(scenario)])


def summarize(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows and attacks per split, with a total row."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_attack"),
            *[c.alias(n) for n, c in (extra or {}).items()]]
    return df.rollup("split").agg(*aggs).withColumn(
        "split", F.coalesce("split", F.lit("total")))


def overlap(assignment: DataFrame, key: str) -> DataFrame:
    """Keys that fall in more than one split; empty when the split is sound."""
    return (assignment.groupBy(key).agg(F.count_distinct("split").alias("n_splits"))
            .filter(F.col("n_splits") > 1))


def resplit_windows(windows: DataFrame, policy: SplitPolicy, strategy: str, *, key: Column, order: Sequence[str] = (),
                    group: str = "", label: str = "y") -> DataFrame:
    """Divide windows anew: ``random`` (stratified), ``temporal`` (``windows`` carries order slices) or ``group``.

    With ``group`` all windows of a device share a side; a null device is a device of its own.
    """
    if strategy == "random":
        return split_random(windows, policy, key, label)
    if strategy == "temporal":
        return split_temporal(windows, policy, order)
    if strategy == "group":
        return attach(windows, deal_groups(windows, policy, group), [group])
    raise ValueError(f"unknown strategy {strategy!r}")
