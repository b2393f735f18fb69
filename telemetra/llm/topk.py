"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Every dimension has two sorted lists of the candidates, descending and
ascending; a query reads the one that its sign asks for.  Lists are read in
rounds of equal depth, only forwards.  After a round a candidate's upper bound
takes the frontier value for each list in which it was not yet seen, its lower
bound the list's last value.  Candidates whose upper bound falls below the k-th
best score known for the query are out; reading stops when none is open, and the
final scores of the rest are resolved.

Candidates are dealt to stripes of bounded size, the query set is sent past each
stripe in blocks, and the best k of the stripes are merged.  The k-th score that
a query reached with earlier batches of a stripe is a valid bound for later ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemetra.session import materialize

#: Candidates of a stripe: what a task holds.
STRIPE = 4096
#: Queries compared with a stripe at once.
QUERIES = 256
#: Shares of each list read after each round.
DEPTHS = (0.5, 1.0)


def quantised(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", factor: float = 64.0) -> DataFrame:
    """(id, v): floor(factor * x) of every component, rows with a null or non-finite component left out.

    A repeated id counts once, with the smallest of its vectors.
    """
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(factor)))
    return (vectors.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(ident).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v")))


class Lists:
    """Sorted lists of one stripe and its bounds after each round."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.n = ids, len(ids)
        order = np.argsort(ids, kind="stable")      # ties go to the smaller id
        self.ids, x = ids[order], x[order]
        self.x = x
        down = -np.sort(-x, axis=0)                 # the lists, one column each
        self.rounds = []
        for share in DEPTHS[:-1]:
            d = max(0, min(self.n, int(np.ceil(share * self.n))) - 1)
            fd, fa = down[d], down[self.n - 1 - d]  # frontiers of the descending and ascending lists
            self.rounds.append((np.maximum(x, fd), np.minimum(x, fa),
                                np.where(x >= fd, x, down[-1]), np.where(x <= fa, x, down[0])))

    def search(self, qid: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, score) of each query's k best here."""
        kind = exact_kind(q, self.x)
        pos, neg = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        own = qid[:, None] == self.ids[None, :]
        open_ = ~own
        least = np.full(len(q), np.iinfo(np.int64).min)
        low = None
        for up_d, up_a, lo_d, lo_a in self.rounds:
            upper = pos @ up_d.T.astype(kind) + neg @ up_a.T.astype(kind)
            low = pos @ lo_d.T.astype(kind) + neg @ lo_a.T.astype(kind)
            if self.n - 1 > k:
                known = np.where(own, -np.inf, low) if kind != np.int64 else np.where(own, np.iinfo(np.int64).min, low)
                at = np.partition(known, self.n - k, axis=1)[:, self.n - k]
                least = np.maximum(least, at.astype(np.int64) if kind == np.int64 else np.where(np.isfinite(at), at, np.iinfo(np.int64).min).astype(np.int64))
                open_ &= upper >= least[:, None]
            if (open_.sum(axis=1) <= k).all() and (np.where(open_, upper - low, 0) == 0).all():
                break
        # the lists are read to their end for what is still open
        score = (q.astype(kind) @ self.x.T.astype(kind)).astype(np.int64)
        score[~open_] = np.iinfo(np.int64).min
        rows, cols = [], []
        if self.n > k:
            edge = np.partition(score, self.n - k, axis=1)[:, self.n - k]
            sure = (score >= edge[:, None]) & open_
        else:
            sure = open_
        r, c = sure.nonzero()
        for i in np.unique(r):
            mine = c[np.searchsorted(r, i):np.searchsorted(r, i, "right")]
            best = mine[np.lexsort((self.ids[mine], -score[i, mine]))[:k]]
            rows.append(np.full(len(best), i))
            cols.append(best)
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        r, c = np.concatenate(rows), np.concatenate(cols)
        return r, self.ids[c], score[r, c]


def exact_kind(q: np.ndarray, x: np.ndarray):
    """The fastest number type in which every sum of products is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, stripe: int = STRIPE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query row.

    ``vectors`` has (id, v) as ``quantised`` gives them; vectors of unequal
    length are compared only with those of their own length.  Fewer candidates
    than k are all returned; no vector gives no row.
    """
    rows = materialize(vectors.withColumn("m", F.size("v")))
    n = rows.count()
    stripes = max(1, -(-n // stripe))
    cand = rows.select(F.pmod(F.xxhash64("id"), F.lit(stripes)).alias("stripe"), F.lit(0).alias("side"), "id", "m", "v")
    ask = rows.filter(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"),
                                       F.lit(1).alias("side"), "id", "m", "v")
    dealt = cand.unionByName(ask).repartition(F.col("stripe"), F.col("m")).sortWithinPartitions("stripe", "m", "side", "id")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists, ids, vecs = None, None, [], []
        for b in batches:
            key = list(zip(b.column("stripe").to_pylist(), b.column("m").to_pylist()))
            side = b.column("side").to_numpy()
            change = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1] or side[i] != side[i - 1]], len(key)]
            for lo, hi in zip(change, change[1:]):
                if lo == hi:
                    continue
                if key[lo] != at:
                    at, lists, ids, vecs = key[lo], None, [], []
                part = b.slice(lo, hi - lo)
                m = key[lo][1]
                x = part.column("v").flatten().to_numpy().reshape(hi - lo, m)
                i = part.column("id").to_numpy()
                if not side[lo]:
                    ids.append(i)
                    vecs.append(x)
                    continue
                if not ids:
                    continue
                lists = lists or Lists(np.concatenate(ids), np.concatenate(vecs))
                for s in range(0, hi - lo, QUERIES):
                    r, c, v = lists.search(i[s:s + QUERIES], x[s:s + QUERIES], k)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(i[s:s + QUERIES][r]), pa.array(c), pa.array(v)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(work, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
