"""Change detection and adaptive baselines over ordered windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.operators.scan import MAX_CHUNK, Step, chunk_rows, chunked_scan

FLAT = 1e-12


@dataclass(frozen=True)
class Cusum:
    """One-sided upward CUSUM of standardized scores; an alarm resets the sum."""

    mean: float
    std: float
    k: float = 0.5
    h: float = 5.0

    def advance(self, score: float, s: float) -> tuple[float, float, bool]:
        """(z, sum after the step, alarm)"""
        z = (score - self.mean) / self.std
        s = max(0.0, s + z - self.k)
        return (z, 0.0, True) if s >= self.h else (z, s, False)


def calibrate(scores: DataFrame, col: str, k: float = 0.5, h: float = 5.0,
              allow_empty: bool = False) -> Cusum:
    """Mean and sample deviation of benign scores; a flat series scales by 1.

    With ``allow_empty`` a stream without benign windows is calibrated on a single score of 0.
    """
    r = scores.agg(F.count(col).alias("n"), F.avg(col).alias("m"), F.stddev_samp(col).alias("s"),
                   F.count(F.when(F.isnan(col) | (F.abs(col) == float("inf")), 1)).alias("bad")).first()
    if not r["n"] and allow_empty:
        return Cusum(0.0, 1.0, k, h)
    if not r["n"] or r["bad"]:
        raise ValueError("benign scores must be present and finite")
    std = r["s"] or 0.0
    return Cusum(float(r["m"]), float(std) if std >= FLAT else 1.0, k, h)


def cusum_alarms(df: DataFrame, stream: Sequence[str], ordinal: str, score: str, detector: Cusum,
                 chunk: int = MAX_CHUNK) -> DataFrame:
    """z, running sum and alarm for each window.  State: [sum]."""
    def step(rows: pd.DataFrame, state: np.ndarray):
        s, zs, sums, alarms = state[0], [], [], []
        for v in rows[score].to_numpy():
            z, s, a = detector.advance(v, s)
            zs.append(z)
            sums.append(s)
            alarms.append(int(a))
        return {"z": zs, "cusum": sums, "alarm": alarms}, np.array([s])

    return chunked_scan(df.select(*stream, ordinal, score), stream, ordinal, step, [0.0],
                        "z double, cusum double, alarm int", chunk)


def _frob(c: np.ndarray, b: np.ndarray) -> float:
    """Frobenius distance from upper triangles; the diagonals are both 1."""
    return float(np.sqrt(2.0 * np.sum((c - b) ** 2)))


def triangle_chunk(df: DataFrame, r: str) -> int:
    """Chunk length for matrices of the size found in the table."""
    row = df.select(F.size(r).alias("k")).first()
    return chunk_rows(row["k"] if row else 1)


def _size(df: DataFrame) -> list[str]:
    return ["n"] if "n" in df.columns else []


def ewma_step(alpha: float, r: str) -> Step:
    """Baseline = first matrix, then alpha * new + (1 - alpha) * old.  State: [triangle] or [].

    Where the table has ``n``, a window of one row has divergence 0 and changes nothing.
    """
    def step(rows: pd.DataFrame, state: np.ndarray):
        base, div = state, []
        for c, k in zip(rows[r].to_numpy(), rows["n"].to_numpy() if "n" in rows else repeat(2)):
            if k < 2:
                div.append(0.0)
                continue
            c = np.asarray(c, dtype=float)
            if base.size == 0:
                base = c.copy()
                div.append(0.0)
                continue
            div.append(_frob(c, base))
            base = alpha * c + (1 - alpha) * base
        return {"divergence": div}, base
    return step


def ewma_trail(df: DataFrame, stream: Sequence[str], ordinal: str, r: str, alpha: float = 0.1,
               start: Sequence[float] = (), chunk: int | None = None) -> DataFrame:
    """Divergence of each window from the baseline *before* it is updated."""
    return chunked_scan(df.select(*stream, ordinal, r, *_size(df)), stream, ordinal, ewma_step(alpha, r), start,
                        "divergence double", chunk or triangle_chunk(df, r))


def ewma_baseline(df: DataFrame, stream: Sequence[str], ordinal: str, r: str, alpha: float = 0.1,
                  start: Sequence[float] = (), chunk: int | None = None) -> DataFrame:
    """Final baseline (upper triangle) per stream."""
    return chunked_scan(df.select(*stream, ordinal, r, *_size(df)), stream, ordinal, ewma_step(alpha, r), start,
                        "divergence double", chunk or triangle_chunk(df, r), end_state=True)


def gate(rows: pd.DataFrame, state: np.ndarray, detector: Cusum, alpha: float,
         min_benign: float, r: str = "r", benign: str = "benign_fraction", n: str = "n"):
    """Advance the guarded baseline over ordered windows.

    State: [sum, *triangle], which both forget their past, so a chunk settles as
    soon as its predecessor's recent windows do; counts come from the rows.  A
    window updates the baseline only without an alarm and with enough benign
    rows; a window of one row has divergence 0 and never updates.
    """
    s, base = state[0], state[1:].copy()
    div, sums, alarms, updates = [], [], [], []
    for c, b, k in zip(rows[r].to_numpy(), rows[benign].to_numpy(), rows[n].to_numpy()):
        c = np.asarray(c, dtype=float)
        v = _frob(c, base) if k >= 2 else 0.0
        _, s, a = detector.advance(v, s)
        u = bool(not a and b >= min_benign and k >= 2)
        if u:
            base = alpha * c + (1 - alpha) * base
        div.append(v)
        sums.append(s)
        alarms.append(int(a))
        updates.append(int(u))
    out = {"divergence": div, "cusum": sums, "alarm": alarms, "updated": updates}
    return out, np.concatenate([[s], base])


GATE_DDL = "divergence double, cusum double, alarm int, updated int"


def gated_adaptation(df: DataFrame, stream: Sequence[str], ordinal: str, start: Sequence[float],
                     detector: Cusum, alpha: float = 0.05, min_benign: float = 0.9,
                     chunk: int | None = None, end_state: bool = False) -> DataFrame:
    """Guarded baseline replay: divergence, CUSUM and updates per window.

    ``df`` has r (upper triangle), benign_fraction and n per window.
    """
    def step(rows: pd.DataFrame, state: np.ndarray):
        return gate(rows, state, detector, alpha, min_benign)

    return chunked_scan(df.select(*stream, ordinal, "r", "benign_fraction", "n"), stream, ordinal, step,
                        [0.0, *start], GATE_DDL, chunk or chunk_rows(len(start)), end_state=end_state)


def benign_scores(df: DataFrame, stream: Sequence[str], ordinal: str, start: Sequence[float],
                  alpha: float = 0.05, chunk: int | None = None) -> DataFrame:
    """Scores of sufficiently benign windows, each taken before it updates the baseline.

    ``df`` holds those windows only, numbered 0, 1, 2, ... per stream.
    """
    return ewma_trail(df, stream, ordinal, "r", alpha, start, chunk)


def first_benign(windows: DataFrame, order: Sequence[str], min_benign: float = 0.9) -> DataFrame:
    """Earliest window with enough benign rows; empty means none qualifies."""
    ok = windows.filter((F.col("n") >= 2) & ((F.col("n") - F.col("n_pos")) >= min_benign * F.col("n")))
    cols = [c for c in windows.columns]
    return ok.agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("w")).select("w.*")
