"""Repeated passages inside and across lines, from content-defined word windows.

A window surrounds an anchor: a pair of words whose hash is the least among
``RADIUS`` neighbours on both sides.  Anchors depend on nearby words alone, so a
passage has the same ones wherever it stands, however lines are broken.  Windows
with equal words are combined by a 64-bit hash; the first occurrence (smallest
document, then place) stays.  A span needs several windows, so that a chance
equality of two hashes makes none.  Overlapping windows that occur earlier join into a
span, also over a short gap if both its sides match the same place, so that an
edited word does not divide it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import Memo, let_go
from telemetra.session import materialize

WORD = re.compile(r"\w+")
WORD_ROOM = 300_000
#: Neighbours on both sides that an anchor is compared with, and words of a window on both sides of it.
RADIUS, HALF = 4, 6
#: Words of a gap that joins two spans that match the same place, and how far they may be shifted against each other.
GAP, SHIFT = 16, 2
#: Words of a span at least: the passage it stands in is a few words longer.
LEAST = 30
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Windows:
    """(first word, hash) of each window of a text, from the hashes of its words."""

    def __init__(self):
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))

        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))

    def __call__(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(w)
        if n < 2 * HALF:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n >= len(self.up):
            self.grow(2 * n)
        c = (w[:-1] * np.uint64(_OTHER)) ^ (w[1:] * np.uint64(_BASE))
        c = (c ^ (c >> np.uint64(29))) * np.uint64(_OTHER)
        least = np.ones(n - 1, bool)
        for k in range(1, min(RADIUS, n - 2) + 1):
            less = c[k:] < c[:-k]
            least[k:] &= less
            least[:-k] &= ~less
        at = least.nonzero()[0]
        at = at[(at >= HALF) & (at + HALF <= n)] - HALF
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * self.up[:n])])
        h = (s[at + 2 * HALF] - s[at]) * self.down[at]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_OTHER)
        return at.astype(np.int64), h.view(np.int64)


def windows(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, at, id): every window of the texts."""
    kind = docs.schema[ident].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        cut = Windows()
        word = Memo(lambda w: xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass")), WORD_ROOM).__getitem__

        def hashes(t: str | None) -> np.ndarray:
            return np.fromiter(map(word, WORD.findall(t or "")), np.uint64)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [cut(hashes(t)) for t in part.column("t").to_pylist()]
                row = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
                if len(row):
                    cols = [pa.array(np.concatenate(c)) for c in zip(*got)]
                    yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(row)), *cols], ["doc", "at", "id"])

    return docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInArrow(work, f"doc {kind}, at long, id long")


def spans_of(found: list[dict], least: int) -> list[tuple[int, int, object, int]]:
    """(first word, end, document and place of the earlier text) of the spans that windows of one document join to."""
    out: list[list] = []
    for x in sorted(found, key=lambda x: x["at"]):
        at, end = x["at"], x["at"] + 2 * HALF
        if out:
            last = out[-1]
            same = last[4] == x["kdoc"] and abs((at - last[6]) - (x["kat"] - last[5])) <= SHIFT
            if at <= last[1] or same and at - last[1] <= GAP:
                last[1], last[4], last[5], last[6] = max(end, last[1]), x["kdoc"], x["kat"], at
                continue
        out.append([at, end, x["kdoc"], x["kat"], x["kdoc"], x["kat"], at])
    return [(s[0], s[1], s[2], s[3]) for s in out if s[1] - s[0] >= least]


def repeated_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST,
                   found: DataFrame | None = None) -> DataFrame:
    """(ident, start, n_words, kept_id, kept_start) of every span of words that occurs earlier.

    Places count words ``\\w+`` of the text from 0.  Null texts and texts of fewer than a window's words have no spans;
    rows that repeat an ident and its text are one document; a null ident orders first; extra columns are ignored.
    ``found`` gives the rows of ``windows`` where they are stored already.
    """
    every = materialize(windows(docs, ident, text)) if found is None else found
    again = (every.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("k"))
             .filter("n > 1").select("id", "k"))
    earlier = ~(F.col("doc").eqNullSafe(F.col("k.doc")) & (F.col("at") == F.col("k.at")))
    # the estimates take the list of a text's windows for one row, so neither side may be broadcast
    later = (every.join(again.hint("merge"), "id").filter(earlier)
             .select("doc", "at", F.col("k.doc").alias("kdoc"), F.col("k.at").alias("kat")))
    by_doc = later.groupBy("doc").agg(F.collect_set(F.struct("at", "kdoc", "kat")).alias("found"))
    kind = docs.schema[ident].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            for i in range(b.num_rows):
                spans = spans_of(b.column("found")[i].as_py(), least)
                if spans:
                    start, end, kdoc, kat = zip(*spans)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc").take(pa.array([i] * len(spans))), pa.array(start, pa.int64()),
                         pa.array([e - s for s, e in zip(start, end)], pa.int64()),
                         pa.array(kdoc, b.column("doc").type), pa.array(kat, pa.int64())],
                        ["doc", "start", "n_words", "kept_id", "kept_start"])

    return by_doc.mapInArrow(work, f"doc {kind}, start long, n_words long, kept_id {kind}, kept_start long").withColumnRenamed("doc", ident)


def cut_text(text: str, lines: list[int], spans: list[tuple[int, int]]) -> str:
    """The text without some lines, by number, and without some stretches of words (first word, words)."""
    cuts = []
    if lines:
        at, gone = 0, set(lines)
        for no, line in enumerate(text.split("\n")):
            if no in gone:
                cuts.append((at, at + len(line) + 1))
            at += len(line) + 1
    if spans:
        place = [m.span() for m in WORD.finditer(text)]
        cuts += [(place[s][0], place[s + n - 1][1]) for s, n in spans]
    out, at = [], 0
    for lo, hi in sorted(cuts):
        if lo > at:
            out.append(text[at:lo])
        at = max(at, hi)
    out.append(text[at:])
    kept = "".join(out)
    # the last line goes with the break before it
    return kept[:-1] if lines and max(lines) == text.count("\n") and kept.endswith("\n") else kept
