"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint becomes a point with one coordinate per segment: the number
of one-bits in it.  Segments of one and two bits alternate: wider ones mean fewer
cells to visit, narrower ones fewer strangers in a cell.  The Manhattan distance of two points never exceeds the
Hamming distance of the fingerprints.  Links are found by a grid range join in
that space: the coordinates are dealt to ``groups``; of two fingerprints within
``d`` bits, some group lies within ``d // groups`` by Manhattan distance, and two
lattice points that close meet in a unit cell if both visit the cells around
them up to half that distance.  What meets is verified on the fingerprints.

The work per fingerprint is a fixed number of cells; no bucket is capped.
Inside a cell a breadth-first search emits a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import let_go, run_bounds, runs, split_cells
from telemetra.llm.components import connected_components
from telemetra.session import materialize

BITS = 64
#: (first bit, width) of each segment: every four bits hold two segments of one bit and one of two.
SEGMENTS = [(4 * i + at, width) for i in range(BITS // 4) for at, width in ((0, 1), (1, 1), (2, 2))]
#: Below this many members all pairs of a cell are compared at once.
SHORT = 8


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Majority of the bits of all word shingles' XXH64, repeats included; no words: 0."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(words, len(w))
    h = xxhash.xxh64_intdigest
    view = memoryview(joined)
    ones = np.zeros(BITS, np.int64)
    s, e = start[:len(w) - k + 1], end[k - 1:]
    for at in range(0, len(s), 1 << 14):
        part = [h(view[a:b], seed) for a, b in zip(s[at:at + (1 << 14)].tolist(), e[at:at + (1 << 14)].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for c in range(0, len(bits), 255):      # sums of 255 bits fit a byte, which numpy adds fastest
            ones += np.add.reduce(bits[c:c + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(s), bitorder="little").view("<u8")[0])


def majorities(flat: np.ndarray, starts: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """The fingerprint of each set of hashes; ``flat`` holds the sets one after another, none of them empty."""
    out, ends, first = np.zeros(len(starts), np.uint64), np.append(starts[1:], len(flat)), 0
    while first < len(starts):                    # sets of about ``chunk`` hashes together
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + chunk, "right")))
        part, at = flat[starts[first]:ends[last - 1]], starts[first:last] - starts[first]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        most = ones * 2 > np.diff(np.append(at, len(part)))[:, None]
        out[first:last] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
        first = last
    return out


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(ident, fp): the fingerprint of every whole text as a signed long.  Null text counts as empty."""
    kind = docs.schema[ident].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(fp, pa.int64())], [ident, "fp"])

    return docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInArrow(work, f"`{ident}` {kind}, fp long")


def cells(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for every unit cell that a fingerprint visits.

    The count of a segment stands in the bits of the segment itself, so the whole
    point packs into a word.  Groups are chosen so that ``distance // groups`` is 2
    at most; each side then visits its own cell and, if that is not 0, the cells
    one step away.  Cells are numbered one to one within a group; two groups may
    share a number, which costs a comparison and loses nothing.
    """
    groups = distance // 3 + 1
    reach = distance // groups
    one, low, pairs = np.uint64(1), np.uint64(0x3333333333333333), np.uint64(0xCCCCCCCCCCCCCCCC)
    counts = (fp & low) | ((fp - ((fp >> one) & np.uint64(0x5555555555555555))) & pairs)
    rows, out, every = [], [], np.arange(len(fp))
    for g in range(groups):
        own = SEGMENTS[g::groups]
        mix = np.uint64(0x9E3779B97F4A7C15 + 2 * g)
        point = counts & np.uint64(sum(((1 << w) - 1) << at for at, w in own))
        found = [(every, point)]
        for at, w in own if reach else ():
            c, step = (counts >> np.uint64(at)) & np.uint64((1 << w) - 1), np.uint64(1 << at)
            found += [(every[c < w], point[c < w] + step), (every[c > 0], point[c > 0] - step)]
        rows += [r for r, _ in found]
        out += [p * mix + np.uint64(g) for _, p in found]
    return np.concatenate(rows), np.concatenate(out)


def _visit(distance: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            fp = b.column("fp").to_numpy()
            for at in range(0, len(fp), 1 << 12):
                part = fp[at:at + (1 << 12)]
                r, c = cells(part.view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(part[r])], ["cell", "fp"])

    return work


def _forest(v: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints in one cell."""
    out, left = [], np.arange(1, len(v))
    queue = [0]
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        near = np.bitwise_count(v[left] ^ v[at]) <= distance
        hit = left[near]
        out += [(at, int(j)) for j in hit]
        queue += hit.tolist()
        left = left[~near]
    return out


def _verify(distance: int):
    keys = ["cell", "_lo", "_hi"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t in runs(batches, keys):
            v = t.column("fp").to_numpy().view(np.uint64)
            us, vs, bounds = [], [], run_bounds(t, keys)
            size = np.array([b - a for a, b in bounds])
            run = np.repeat(np.arange(len(bounds)), size)
            short = np.repeat(size <= SHORT, size)
            for k in range(1, SHORT):          # all pairs of the short runs, a shift at a time
                if k >= len(v):
                    break
                ok = short[:-k] & (run[:-k] == run[k:])
                at = ok.nonzero()[0]
                at = at[np.bitwise_count(v[at] ^ v[at + k]) <= distance]
                us.append(v[at])
                vs.append(v[at + k])
            for a, b in (x for x, n in zip(bounds, size) if n > SHORT):
                if links := _forest(v[a:b], distance):
                    i, j = np.array(links).T
                    us.append(v[a + i])
                    vs.append(v[a + j])
            if us:
                u, w = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["u", "v"])

    return work


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within ``distance`` bits.

    Every pair within the distance ends in one component; each cell gives a spanning forest.
    """
    if not 0 <= distance <= 32:
        raise ValueError("distance must lie between 0 and 32 bits")
    members = distinct.select("fp").mapInArrow(_visit(distance), "cell long, fp long")
    return (split_cells(members, "cell", "fp").select("cell", "_lo", "_hi", "fp")
            .mapInArrow(_verify(distance), "u long, v long").distinct())


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 4,
                    distance: int = 4) -> DataFrame:
    """(ident, fp, component): every row with the smallest ident it can reach.

    Copies share a fingerprint and are combined before anything is compared.
    Null or wordless texts have fingerprint 0 and link like any other.  A null
    ident keeps its row and never names a component unless it has only nulls.
    Extra columns are ignored; repeated rows each return.
    """
    fps = materialize(fingerprints(docs, ident, text, words))
    distinct = materialize(fps.groupBy("fp").agg(F.min(ident).alias("first")))
    roots = connected_components(links(distinct.select("fp"), distance))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lead = joined.groupBy("root").agg(F.min("first").alias("component"))
    named = joined.join(lead, "root").select("fp", "component")
    return fps.join(named, "fp").select(ident, "fp", "component")
