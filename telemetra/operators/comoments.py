"""Correlation of many columns per window, from mergeable co-moments.

A window's co-moments are its count, means and the triangle of summed products
of deviations.  Those of two parts merge into those of the whole, so each task
reduces the rows it holds, of many windows in a batch, to one record per window;
only these records are shuffled, and merged where they meet.  145 columns are
10,585 numbers a record, where an aggregate per pair would be as many columns
of a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAT = 1e-12   # deviation at or below which a column counts as constant
#: Windows a task keeps open; beyond that the oldest record leaves and merges later.
OPEN = 64
#: Values of a stack of windows or of their matrices that are worked on at once (16 MB).
STACK = 1 << 21
LONG_LIST = pa.list_(pa.float64())
#: From the rows and co-moments of windows of equal size to result columns.
Finish = Callable[[int, np.ndarray], dict[str, pa.Array]]


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    dev: np.ndarray      # dim x dim sums of products of deviations

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        d = x - mean
        return Moments(len(x), mean, d.T @ d)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.dev + other.dev + np.outer(gap, gap) * (self.n * other.n / n))

    def correlation(self) -> np.ndarray:
        return matrices(self.n, self.dev[None])[0]


def matrices(n: int, dev: np.ndarray) -> np.ndarray:
    """Correlation matrices of a stack of co-moments, each of ``n`` rows.

    The diagonal is 1; a constant column has 0 with every other, and so has a single row.
    """
    at = np.arange(dev.shape[1])
    sd = np.sqrt(np.clip(dev[:, at, at], 0, None) / max(n - 1, 1))
    live = sd > FLAT
    scale = np.where(live, sd, 1.0)
    r = dev / max(n - 1, 1) / (scale[:, :, None] * scale[:, None, :])
    r = np.where(live[:, :, None] & live[:, None, :], r, 0.0)
    r[:, at, at] = 1.0
    return r


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def _keys_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def _triangles(m: np.ndarray, iu) -> pa.ListArray:
    """The entries ``iu`` of each matrix of a stack."""
    flat = m[:, iu[0], iu[1]]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _stacks(x: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first row of each group, rows by group) for all groups of one size at a time, not more than a bounded number of values."""
    order = np.argsort(group, kind="stable")
    first = np.append(0, np.flatnonzero(np.diff(group[order])) + 1)
    size = np.diff(np.append(first, len(order)))
    for m in np.unique(size):
        starts = first[size == m]
        step = max(1, STACK // (x.shape[1] * max(int(m), x.shape[1])))
        for k in range(0, len(starts), step):
            at = order[starts[k:k + step, None] + np.arange(m)]
            yield at[:, 0], x[at]


@dataclass(frozen=True)
class Derived:
    """Component columns made inside the tasks: ``make`` turns arrays of the columns ``of`` into rows x components.

    A plan that computes dozens of columns in one stage is a method too long for the JVM to compile.  A row with
    a null in ``of`` counts as missing.
    """

    of: Sequence[str]
    make: Callable[..., np.ndarray]


Values = Column | Derived


def partial_moments(df: DataFrame, keys: Sequence[str], values: Values, dim: int, size: int | None = None, ddl: str = "",
                    finish: Finish | None = None) -> DataFrame:
    """(keys, n, mean, tri, and what ``finish`` makes): one or more records per window.  Rows with a missing component are left out.

    No window has more than ``size`` rows: one that has them all in a task is finished there, and its record has no mean and tri.
    """
    keys, iu, made = list(keys), np.triu_indices(dim), _made(ddl)
    make = values.make if isinstance(values, Derived) else None
    parts = [f"_v{i}" for i in range(len(values.of))] if make else []
    rows = df.select(*keys, *([F.col(c).alias(p) for c, p in zip(values.of, parts)] if make else [values.cast("array<double>").alias("v")]))
    names = [*keys, "n", "mean", "tri", *made]

    def present(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        if make:
            for c in parts:
                if b.column(c).null_count:
                    b = b.filter(b.column(c).is_valid())
            x = make(*[b.column(c).to_numpy(zero_copy_only=False) for c in parts])
            gaps = np.isnan(x).any(axis=1)
            return (b.filter(pa.array(~gaps)), x[~gaps]) if gaps.any() else (b, x)
        v = b.column("v")
        n = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
        if (n != dim).any():
            b = b.filter(pa.array(n == dim))
            v = b.column("v")
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dim)
        gaps = np.isnan(x).any(axis=1)
        return (b.filter(pa.array(~gaps)), x[~gaps]) if gaps.any() else (b, x)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        kinds: list[pa.DataType] = []

        def record(items: list[tuple[tuple, Moments]]) -> pa.RecordBatch:
            cols = [pa.array([k[i] for k, _ in items], t) for i, t in enumerate(kinds)]
            cols += [pa.array([m.n for _, m in items], pa.int64()), pa.array([m.mean for _, m in items], LONG_LIST),
                     _triangles(np.stack([m.dev for _, m in items]), iu), *[pa.nulls(len(items), t) for t in made.values()]]
            return pa.RecordBatch.from_arrays(cols, names)

        def whole(keys_of: list[pa.Array], dev: np.ndarray) -> pa.RecordBatch:
            got, n = finish(size, dev), len(dev)
            return pa.RecordBatch.from_arrays([*keys_of, pa.array(np.full(n, size)), pa.nulls(n, LONG_LIST), pa.nulls(n, LONG_LIST),
                                               *[got[c] for c in made]], names)

        for b in batches:
            kinds = [b.column(k).type for k in keys]
            b, x = present(b)
            if not b.num_rows:
                continue
            if keys:
                group = b.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            else:
                group = np.zeros(b.num_rows, int)
            ready: list[tuple[tuple, Moments]] = []
            for first, part in _stacks(x, group):
                mean = part.mean(axis=1)
                d = part - mean[:, None, :]
                dev = d.transpose(0, 2, 1) @ d
                if part.shape[1] == size:
                    yield whole([b.column(k).take(pa.array(first)) for k in keys], dev)
                    continue
                for i, at in enumerate(first.tolist()):
                    key = tuple(b.column(k)[at].as_py() for k in keys)
                    m = Moments(part.shape[1], mean[i], dev[i])
                    old = held.pop(key, None)
                    m = old.merge(m) if old else m
                    if m.n == size:
                        ready.append((key, m))
                    else:
                        held[key] = m
            if ready:
                yield whole([pa.array([k[i] for k, _ in ready], t) for i, t in enumerate(kinds)], np.stack([m.dev for _, m in ready]))
            if len(held) > OPEN:
                old = list(held)[:len(held) - OPEN]
                for k in range(0, len(old), OPEN):
                    yield record([(key, held.pop(key)) for key in old[k:k + OPEN]])
        if held:
            yield record(list(held.items()))

    return rows.mapInArrow(work, f"{_keys_ddl(df, keys)}n long, mean array<double>, tri array<double>{', ' + ddl if ddl else ''}")


def _made(ddl: str) -> dict[str, pa.DataType]:
    return {c.split()[0]: LONG_LIST if "array" in c else pa.float64() for c in ddl.split(", ") if c}


def fold_moments(df: DataFrame, keys: Sequence[str], values: Values, dim: int, ddl: str, finish: Finish, size: int | None = None) -> DataFrame:
    """(keys, n, and what ``finish`` makes of each window's moments, as ``ddl`` says)."""
    keys, iu, made = list(keys), np.triu_indices(dim), _made(ddl)
    parts = partial_moments(df, keys, values, dim, size, ddl, finish)
    met = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.repartition(1)
    names = [*keys, "n", *made]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        key, held, closed = None, None, []

        def out() -> pa.RecordBatch:
            got = [finish(m.n, m.dev[None]) for _, m in closed]
            cols = [pa.array([k[i] for k, _ in closed], t) for i, t in enumerate(kinds)]
            done = pa.RecordBatch.from_arrays([*cols, pa.array([m.n for _, m in closed], pa.int64()),
                                               *[pa.concat_arrays([g[c] for g in got]) for c in made]], names)
            closed.clear()
            return done

        for b in batches:
            kinds = [b.column(k).type for k in keys]
            ready = b.filter(pc.is_null(b.column("mean")))
            if ready.num_rows:
                yield ready.select(names)
            b = b.filter(pc.is_valid(b.column("mean")))
            for i in range(b.num_rows):
                this = tuple(b.column(k)[i].as_py() for k in keys)
                dev = np.zeros((dim, dim))
                dev[iu] = b.column("tri")[i].values.to_numpy()
                dev = dev + np.triu(dev, 1).T
                m = Moments(b.column("n")[i].as_py(), b.column("mean")[i].values.to_numpy(), dev)
                if held is not None and this == key:
                    held = held.merge(m)
                    continue
                if held is not None:
                    closed.append((key, held))
                    if len(closed) >= OPEN:
                        yield out()
                key, held = this, m
        if held is not None:
            closed.append((key, held))
            yield out()

    return met.mapInArrow(work, f"{_keys_ddl(df, keys)}n long, {ddl}")


def correlations(df: DataFrame, keys: Sequence[str], values: Values, dim: int) -> DataFrame:
    """(keys, n, r): the upper triangle of each window's correlation matrix, row by row, without the diagonal."""
    up = np.triu_indices(dim, 1)
    return fold_moments(df, keys, values, dim, "r array<double>",
                        lambda n, dev: {"r": _triangles(matrices(n, dev), up)})


def baseline(df: DataFrame, values: Values, dim: int) -> np.ndarray | None:
    """Correlation matrix of all rows: dim * dim numbers on the driver.  None below two rows."""
    row = correlations(df, [], values, dim).first()
    if row is None or row["n"] < 2:
        return None
    out, up = np.eye(dim), np.triu_indices(dim, 1)
    out[up] = row["r"]
    return out + np.triu(out, 1).T


def divergences(df: DataFrame, keys: Sequence[str], values: Values, base: np.ndarray, size: int | None = None) -> DataFrame:
    """(keys, n, divergence): Frobenius distance to a baseline matrix; null for a window of one row.

    With ``size``, the most rows that a window has, only windows that lie in several tasks or have fewer rows are shuffled as moments.
    """
    def finish(n: int, dev: np.ndarray) -> dict[str, pa.Array]:
        far = np.sqrt(((matrices(n, dev) - base) ** 2).sum(axis=(1, 2)))
        return {"divergence": pa.array(far) if n >= 2 else pa.nulls(len(dev), pa.float64())}

    return fold_moments(df, keys, values, len(base), "divergence double", finish, size)


def long_form(r: DataFrame, keys: Sequence[str], features: Sequence) -> DataFrame:
    """(keys, i, j, r) rows from the triangles."""
    names = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for k, a in enumerate(features) for b in features[k + 1:]]
    one = F.explode(F.arrays_zip(F.array(*names).alias("p"), F.col("r").alias("r"))).alias("x")
    return r.select(*keys, one).select(*keys, "x.p.i", "x.p.j", "x.r")
