"""Exact nearest neighbours by space partitioning, and SMOTE on top of it.

Distinct vectors are cut into cells by median splits of a bounded sample.  A
query first meets its own cell, which bounds the distance to its k-th neighbour;
then only cells whose box lies within that bound are visited.  No pair outside
those cells is formed, nothing is approximated, and both the members and the
visitors of a cell are divided into groups of limited size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.functions.seeded import shuffle_key, unit_interval
from telemetra.operators.balance import _two, first_of_shuffle
from telemetra.operators.splits import class_sizes
from telemetra.session import materialize

SAMPLE_ROWS = 50_000
LEAF = 500         # target members per cell
GROUP = 4_000      # limit of members and of visitors per task group
TASK = 20_000      # members per task of the search
MAX_DEPTH = 13


class Cells:
    """Axis-parallel cells from median splits; 2**depth of them.  Boxes are kept for every node of the tree."""

    def __init__(self, sample: np.ndarray, depth: int):
        f = sample.shape[1]
        self.depth, self.n = depth, 2 ** depth
        self.dim = np.zeros(self.n - 1, dtype=int)
        self.cut = np.zeros(self.n - 1)
        self.lo = np.full((2 * self.n - 1, f), -np.inf)
        self.hi = np.full((2 * self.n - 1, f), np.inf)
        self._split(0, sample, np.full(f, -np.inf), np.full(f, np.inf))

    def _split(self, node: int, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo[node], self.hi[node] = lo, hi
        if node >= self.n - 1:
            return
        d = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
        c = float(np.median(x[:, d])) if len(x) else 0.0
        self.dim[node], self.cut[node] = d, c
        right = x[:, d] > c
        hi_left, lo_right = hi.copy(), lo.copy()
        hi_left[d], lo_right[d] = min(hi[d], c), max(lo[d], c)
        self._split(2 * node + 1, x[~right], lo, hi_left)
        self._split(2 * node + 2, x[right], lo_right, hi)

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.dim[node]] > self.cut[node])
        return node - (self.n - 1)

    def within(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of the cells whose box is no farther than a point's radius, found from the root down."""
        row, node = np.arange(len(q)), np.zeros(len(q), dtype=int)
        for _ in range(self.depth):
            row, node = np.repeat(row, 2), np.repeat(2 * node + 1, 2)
            node[1::2] += 1
            gap = np.maximum(np.maximum(self.lo[node] - q[row], q[row] - self.hi[node]), 0.0)
            near = np.sqrt((gap ** 2).sum(axis=1)) <= radius[row]
            row, node = row[near], node[near]
        return row, node - (self.n - 1)


def _nearest(q: np.ndarray, x: np.ndarray, m: np.ndarray, radius: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, distance, vector, rows) of members inside the radius that cover k neighbours counted with multiplicity.

    Ties go to the smaller vector, so neither the cells nor the order of arrival decides.
    """
    order = np.lexsort(x.T[::-1])
    x, m = x[order], m[order]
    last, step = min(k, len(x) - 1), max(1, 1_000_000 // len(x))
    for a in range(0, len(q), step):
        part = q[a:a + step]
        d = np.zeros((len(part), len(x)))
        for c in range(x.shape[1]):
            d += (part[:, c, None] - x[None, :, c]) ** 2
        d = np.sqrt(d)
        far = np.minimum(np.partition(d, last, axis=1)[:, last], radius[a:a + step])
        i, j = np.nonzero(d <= far[:, None])
        near = np.lexsort((d[i, j], i))
        i, j = i[near], j[near]
        first = np.arange(len(i)) - np.searchsorted(i, i) <= k
        i, j = i[first], j[first]
        rows = m[j] - (part[i] == x[j]).all(axis=1)
        other = rows > 0
        i, j = i[other], j[other]
        yield a + i, d[i, j], x[j], rows[other]


def knn(df: DataFrame, features: Sequence[str], k: int, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """(features, neighbours): the k nearest rows of each distinct vector, itself excluded; ties go to the smaller vector.

    Equal rows are combined first with their count, so any number of copies is
    one member; copies are neighbours at distance 0.  Distances to a null or NaN
    are not defined: a row with one is an error, to be imputed or dropped before.
    """
    names = list(features)
    pts = materialize(df.groupBy(*names).agg(F.count(F.lit(1)).alias("m")))
    gaps = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in names]
    if pts.filter(functools.reduce(Column.__or__, gaps)).limit(1).count():
        raise ValueError("rows with a missing feature have no neighbours")
    n = pts.count()
    # digests are uniform: about SAMPLE_ROWS of them lie below this share
    digest = shuffle_key(0, *[F.col(c) for c in names])
    sample = pts.filter(unit_interval(digest) < F.lit(SAMPLE_ROWS / max(1, n))).select(*names).toPandas()
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, n) / leaf)))))
    cells = Cells(sample.to_numpy(float), depth)
    # the search costs far more than its bytes suggest, so its partitions are numbered by members
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK))
    feat = ", ".join(f"`{c}` double" for c in names)
    at = [f"_x{i}" for i in range(len(names))]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=cells.locate(b[names].to_numpy(float)))

    members = materialize(pts.mapInPandas(place, f"{feat}, m long, cell long"))
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.select("cell", F.ceil(F.col("size") / F.lit(group)).alias("parts"))
    key = F.abs(F.xxhash64(*names))
    members = members.join(parts, "cell").withColumn("part", key % F.col("parts"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """left: visitors, right: members of one (cell, part, visitor group)."""
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in [*names, "d", *at, "m"]})
        q = left[names].to_numpy(float)
        found = _nearest(q, right[names].to_numpy(float), right["m"].to_numpy(), left["radius"].to_numpy(float), k)
        i, d, x, m = map(np.concatenate, zip(*found))
        return pd.DataFrame(np.column_stack([q[i], d, x]), columns=[*names, "d", *at]).assign(m=m)

    def meet(visits: DataFrame) -> DataFrame:
        """Candidates of visitors (features, cell, radius) in all parts of the visited cells."""
        # fresh column identities: members may stand on both sides
        visits = visits.select(*[F.col(c).alias(c) for c in [*names, "cell", "radius"]])
        load = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(group)).alias("groups"))
        v = (visits.join(load, "cell").join(parts, "cell")
             .withColumn("g", key % F.col("groups"))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
        w = members.join(load, "cell").withColumn(
            "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        by = ["cell", "part", "g"]
        return (v.select(*by, *names, "radius").repartition(tasks, *by).groupBy(*by)
                .cogroup(w.select(*by, *names, "m").repartition(tasks, *by).groupBy(*by))
                .applyInPandas(search, f"{feat}, d double, {', '.join(f'{c} double' for c in at)}, m long"))

    def best(cand: DataFrame, out: str) -> DataFrame:
        """The k nearest of all candidates, copies counted."""
        s = F.array_sort(F.collect_list(F.struct("d", F.array(*at).alias("x"), "m")))
        flat = F.flatten(F.transform(s, lambda e: F.array_repeat(F.struct(e["d"].alias("d"), e["x"].alias("x")),
                                                                 F.least(e["m"], F.lit(k)).cast("int"))))
        return cand.groupBy(*names).agg(F.slice(flat, 1, k).alias(out))

    everywhere = F.lit(float("inf"))
    own = best(meet(members.select(*names, "cell").withColumn("radius", everywhere)), "_own")
    own = materialize(members.select(*names, "cell").join(own, names, "left"))
    bound = F.when(F.size("_own") >= k, F.element_at("_own", -1)["d"]).otherwise(everywhere)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first in range(0, len(b), 1_000):
                c = b.iloc[first:first + 1_000]
                q, r = c[names].to_numpy(float), c["radius"].to_numpy(float)
                row, cell = cells.within(q, r)
                other = cell != c["cell"].to_numpy()[row]
                row, cell = row[other], cell[other]
                yield pd.DataFrame(q[row], columns=names).assign(cell=cell, radius=r[row])

    others = materialize(own.select(*names, "cell", bound.alias("radius")).mapInPandas(visit, f"{feat}, cell long, radius double"))
    both = own.join(best(meet(others), "_far"), names, "left")
    nb = (F.when(F.col("_far").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_far"))
          .otherwise(F.slice(F.array_sort(F.concat("_own", "_far")), 1, k)))
    return both.withColumn("nb", nb).filter("nb is not null").select(
        *names, F.transform("nb", lambda e: e["x"]).alias("neighbours"), F.transform("nb", lambda e: e["d"]).alias("distances"))


def smote(df: DataFrame, features: Sequence[str], key: Column, seed: int, k: int = 5,
          label: str = "label", **options: int) -> DataFrame:
    """Synthetic minority rows on the segment between a row and one of its k neighbours.

    As many are made as the majority class is larger.  Base rows are taken in a
    seeded shuffle, each equally often up to one; no row is numbered for it; the neighbour and the position
    on the segment come from the digest of (seed, row, copy).
    """
    names = list(features)
    sizes = class_sizes(df, label)
    minority, majority = _two(sizes)
    n = sizes.get(minority, 0)
    need = sizes.get(majority, 0) - n
    small = df.filter(F.col(label) == minority)
    if n < 2 or need <= 0:
        return small.select(*names, label).withColumn("copy", F.lit(0)).limit(0)
    k = min(k, n - 1)
    times, rest = divmod(need, n)
    small = materialize(small.select(*names, label, key.alias("_key"), shuffle_key(seed, key).alias("_h")))
    # every row from copy 0 on, and the first of the shuffle once more; copies are made after the join
    once_more = first_of_shuffle(small, F.col("_h"), rest).select(*names, label, "_key", F.lit(times).alias("_from"), F.lit(times).alias("_to"))
    rows = once_more if not times else once_more.unionByName(
        small.select(*names, label, "_key", F.lit(0).alias("_from"), F.lit(times - 1).alias("_to")))
    rows = rows.join(knn(small, names, k, **options), names)
    rows = rows.withColumn("copy", F.explode(F.sequence("_from", "_to")))
    h = shuffle_key(seed, F.col("_key"), F.col("copy"))
    pick = F.floor(unit_interval(h) * F.size("neighbours")).cast("int")
    u = unit_interval(F.substring(h, 9, 8))
    other = F.get("neighbours", pick)
    out = rows.withColumn("_o", other).withColumn("_u", u)
    return out.select(*[(F.col(c) + F.col("_u") * (F.col("_o")[i] - F.col(c))).alias(c)
                        for i, c in enumerate(names)], label, "copy",
                      *[F.col(c).alias(f"base_{c}") for c in names], F.col("_o").alias("neighbour"))
