"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a cell that one task holds at most, twice over (a pair of blocks).
BLOCK = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keyed(docs: DataFrame, ident: str = "doc_id", text: str = "text", key: str = "_row") -> DataFrame:
    """The rows with a key that only rows equal in ident and text share, ordered by ident first.

    Where no ident is null or repeated, the ident itself is the key.
    """
    ids = docs.groupBy(ident).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter(F.col(ident).isNull() | (F.col("n") > 1)).limit(1).count():
        content = F.md5(F.col(text).cast("binary"))         # a null text has a null hash, which no text has
        return docs.withColumn(key, F.struct(F.col(ident).alias("id"), content.alias("content")))
    return docs.withColumn(key, F.col(ident))


def split_cells(members: DataFrame, cell: str, ident: str, block: int = BLOCK) -> DataFrame:
    """Deal the members of each cell to tasks of bounded size.

    A cell of up to ``block`` members is one task.  A larger one is cut into
    hash blocks, and every pair of blocks is a task, so any two members meet and
    no task holds more than about ``2 * block``.  Cells of one member go.
    Members mostly come from a step that makes many rows of one, of which Spark's
    estimates know nothing: neither side of the join is broadcast.
    Adds ``_lo`` and ``_hi``; rows come out clustered by (cell, _lo, _hi).
    """
    sizes = members.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(float(block))).cast("long")
    mine = F.pmod(F.xxhash64(ident), F.col("_blocks"))
    dealt = (members.join(sizes.hint("merge"), cell).withColumn("_blocks", blocks).withColumn("_mine", mine)
             .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
             .withColumn("_lo", F.least("_mine", "_other")).withColumn("_hi", F.greatest("_mine", "_other"))
             .drop("_n", "_blocks", "_mine", "_other"))
    keys = [cell, "_lo", "_hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, ident)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive whole runs of equal keys; each table holds at least one run.

    Rows arrive clustered by ``keys``.  Only the last run of a batch is carried
    to the next one.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        joins = bool(held) and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)
        last = int(change.nonzero()[0][-1]) if change.any() else 0
        if held and (last or not joins):
            first = int(change.nonzero()[0][0]) if joins and change.any() else 0
            yield pa.Table.from_batches([*held, b.slice(0, first)] if first else held)
            held = []
            if first < last:
                yield pa.Table.from_batches([b.slice(first, last - first)])
            held = [b.slice(last)]
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(t: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys in a table."""
    import numpy as np

    n = t.num_rows
    change = np.ones(n + 1, bool)
    if n > 1:
        change[1:n] = False
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:n] |= v[1:] != v[:-1]
    at = change.nonzero()[0]
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


class Memo(dict):
    """word -> value, computed once while there is room, so memory is bounded."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room = make, room

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.room:
            self[key] = value
        return value


_held: dict[object, object] = {}


def held(key, make: Callable):
    """What ``make`` gives, once per Python worker, until a task of another operator lets it go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what other operators hold in this Python worker: it lives on through all steps of a job."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
