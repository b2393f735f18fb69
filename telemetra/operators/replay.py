"""Replay of windows whose gate depends on the model, and the model on the replayed state.

A window's divergence from the adaptive baseline is a feature of its own rows.
Their predictions decide whether the window updates the baseline, so the fold's
input depends on its state.  Trees see the divergence only through the values
they split on: between two of these nothing changes.  So the share of benign
predictions of every window is computed for every interval between split values,
in parallel over all rows, and the sequential fold looks up the interval its
divergence falls into.  The fold touches one number per interval and window, not
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.operators import models, online
from telemetra.operators.ordering import join_null_safe
from telemetra.operators.scan import chunk_rows, chunked_scan

Tree = dict[str, np.ndarray]
#: Numbers held for a batch of rows and all intervals (32 MB).
HELD = 1 << 22


def boosted_probability(margin: np.ndarray) -> np.ndarray:
    """Probability of a boosted classifier's margin."""
    return 1.0 / (1.0 + np.exp(-2.0 * margin))


def clipped(value: np.ndarray) -> np.ndarray:
    """Probability of a regression student."""
    return np.clip(value, 0.0, 1.0)


def split_values(trees: Sequence[Tree], feature: int) -> np.ndarray:
    """Sorted distinct values at which the trees split on a feature."""
    found = [t["threshold"][(t["left"] >= 0) & (t["feature"] == feature)] for t in trees]
    return np.unique(np.concatenate(found)) if found else np.zeros(0)


def leaves(t: Tree, x: np.ndarray) -> np.ndarray:
    """Weighted leaf value of each row."""
    node = np.zeros(len(x), int)
    live = (t["left"][node] >= 0).nonzero()[0]
    while len(live):
        n = node[live]
        node[live] = np.where(x[live, t["feature"][n]] <= t["threshold"][n], t["left"][n], t["right"][n])
        live = live[t["left"][node[live]] >= 0]
    return t["w"] * t["pred"][node]


def interval_values(trees: Sequence[Tree], x: np.ndarray, feature: int, cuts: np.ndarray) -> np.ndarray:
    """Sum of the trees for each row and each interval (.., c0], (c0, c1], .. (ck, ..) of one feature's values."""
    out = np.zeros((len(x), len(cuts) + 1))
    rows = x.copy()
    for t in trees:
        own = split_values([t], feature)
        if not len(own):
            out += leaves(t, rows)[:, None]
            continue
        made = []
        for v in [*own, np.inf]:
            rows[:, feature] = v
            made.append(leaves(t, rows))
        # the interval of a global one in the tree's own cuts
        at = np.append(np.searchsorted(own, cuts, "left"), len(own))
        out += np.stack(made, axis=1)[:, at]
    return out


def interval_shares(df: DataFrame, keys: Sequence[str], trees: Sequence[Tree], features: Sequence[str], drift: str,
                    threshold: float, link: Callable[[np.ndarray], np.ndarray] = boosted_probability) -> tuple[DataFrame, np.ndarray]:
    """(keys, shares) and the cuts: per window the share of rows predicted below the threshold, by interval of ``drift``.

    The column ``drift`` itself is not read.  Each task counts the rows it holds; windows in several tasks are summed.
    Models are small: trees and cuts travel with the task.
    """
    keys, names = list(keys), list(features)
    at = names.index(drift)
    cuts = split_values(trees, at)
    rows = df.select(*keys, F.array(*[F.lit(0.0) if f == drift else F.col(f).cast("double") for f in names]).alias("x"))
    kinds = dict(df.dtypes)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // (len(cuts) + 1))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                flat = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
                below = link(interval_values(trees, flat.reshape(b.num_rows, len(names)), at, cuts)) < threshold
                group = (b.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                         if keys else np.zeros(b.num_rows, int))
                first = np.unique(group, return_index=True)[1]
                counts = np.zeros((len(first), len(cuts) + 1))
                np.add.at(counts, group, below)
                size = np.bincount(group).astype(float)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).take(pa.array(first)) for k in keys], pa.array(np.column_stack([size, counts]).tolist())], [*keys, "c"])

    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    parts = rows.mapInArrow(work, f"{ddl}c array<double>")
    sums = parts.select(*keys, F.posexplode("c").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
    put = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c"))
    total = F.get("c", F.lit(0))["v"]
    shares = F.transform(F.slice("c", 2, len(cuts) + 1), lambda s: s["v"] / total)
    return put.select(*keys, shares.alias("shares")), cuts


def feedback_replay(windows: DataFrame, stream: Sequence[str], ordinal: str, start: Sequence[float], detector: online.Cusum,
                    cuts: np.ndarray, alpha: float = 0.05, min_benign: float = 0.9, chunk: int | None = None) -> DataFrame:
    """``online.gated_adaptation`` with the benign share of each window taken at the divergence the fold has reached.

    ``windows`` has r (upper triangle), n and shares.  Returns divergence, cusum, alarm, updated and benign_fraction.
    A window of one row has divergence 0 and never updates.
    """
    def step(rows, state: np.ndarray):
        s, base = state[0], state[1:].copy()
        out: dict[str, list] = {k: [] for k in ("divergence", "cusum", "alarm", "updated", "benign_fraction")}
        for c, shares, n in zip(rows["r"].to_numpy(), rows["shares"].to_numpy(), rows["n"].to_numpy()):
            c = np.asarray(c, float)
            v = float(np.sqrt(2.0 * np.sum((c - base) ** 2))) if n >= 2 else 0.0
            _, s, alarm = detector.advance(v, s)
            benign = float(shares[int(np.searchsorted(cuts, v, "left"))])
            moves = bool(not alarm and benign >= min_benign and n >= 2)
            if moves:
                base = alpha * c + (1 - alpha) * base
            for k, x in zip(out, (v, s, int(alarm), int(moves), benign)):
                out[k].append(x)
        return out, np.concatenate([[s], base])

    return chunked_scan(windows.select(*stream, ordinal, "r", "n", "shares"), stream, ordinal, step, [0.0, *start],
                        f"{online.GATE_DDL}, benign_fraction double", chunk or chunk_rows(len(start) + len(cuts) + 1))


def replayed_rows(df: DataFrame, trail: DataFrame, keys: Sequence[str], drift: str) -> DataFrame:
    """The rows with the divergence that their window had in the replay as their drift feature."""
    seen = trail.select(*keys, F.col("divergence").alias(drift))
    return join_null_safe(df.drop(drift), seen, list(keys))

