"""Documents packed into training sequences of several lengths, almost without padding.

Tiers are context lengths, each the double of the one before.  A document is cut
into whole windows of the longest tier, which are sequences by themselves; what
is left goes to the shortest tier that holds it.  Each tier is packed by best fit,
longest first.  Gaps in the windows of a tier are filled from shorter tiers: by
whole remainders that fit, longest first, then by the beginning of one that is
cut for it.  A window that still has a gap waits for the next pool of documents;
at the end of a partition it is cut into lengths that are powers of two, which
need no padding, down to ``least`` tokens.

Sequences of a tier form step groups of equal tokens.  Attention costs the square
of a piece's length, so groups are balanced by it: the costliest sequence goes to
the group with the least so far.

Documents never leave the partition that reads them, so nothing is shuffled.  A
task holds one pool of tokens and the windows that wait.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.token_files import CHARS, packed

TIERS = (256, 512, 1024, 2048)
#: Tokens packed together; a longer document is a pool by itself.
POOL = 4_000_000
#: Shortest sequence that the last windows of a partition are cut to; what is shorter is padded to the longest tier.
LEAST = 1
#: Tokens of a training step.
STEP = 1 << 17
#: Bits of a sequence number below the number of its partition.
SHIFT = 36


@dataclass
class Piece:
    """Consecutive tokens of a document: from ``start``, ``length`` of them."""

    doc: int
    start: int
    length: int


@dataclass
class Window:
    room: int
    pieces: list[Piece] = field(default_factory=list)

    def add(self, p: Piece) -> None:
        self.pieces.append(p)
        self.room -= p.length

    @property
    def length(self) -> int:
        return sum(p.length for p in self.pieces)


class Shelf:
    """Pieces by length, to take the longest that fits."""

    def __init__(self, pieces: Iterable[Piece] = ()):
        self.held: dict[int, list[Piece]] = {}
        for p in pieces:
            self.held.setdefault(p.length, []).append(p)
        self.sizes = sorted(self.held)

    def __bool__(self) -> bool:
        return bool(self.sizes)

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` tokens; of equal ones the last put."""
        i = bisect.bisect_right(self.sizes, most) - 1
        if i < 0:
            return None
        n = self.sizes[i]
        p = self.held[n].pop()
        if not self.held[n]:
            del self.held[n], self.sizes[i]
        return p

    def put(self, p: Piece) -> None:
        if p.length not in self.held:
            self.held[p.length] = []
            bisect.insort(self.sizes, p.length)
        self.held[p.length].append(p)

    def smallest(self) -> int:
        return self.sizes[0] if self.sizes else 0


def route(doc: int, n: int, tiers: tuple[int, ...]) -> tuple[list[Window], Piece | None]:
    """Whole windows of a document of n tokens, and what is left of it."""
    top = tiers[-1]
    whole = [Window(0, [Piece(doc, at, top)]) for at in range(0, n - top + 1, top)]
    rest = n % top
    return whole, Piece(doc, n - rest, rest) if rest else None


def pack(rests: list[Piece], waiting: list[Window], tiers: tuple[int, ...]) -> tuple[list[Window], list[Window]]:
    """(full windows, windows with a gap) of the pieces, those that waited before being filled first.

    Each piece is shorter than the longest tier.
    """
    shelves = {t: Shelf() for t in tiers}
    for p in sorted(rests, key=lambda p: -p.length):
        shelves[next(t for t in tiers if p.length <= t)].put(p)
    full: list[Window] = []
    still: list[Window] = []
    for w in waiting:
        _fill(w, [shelves[t] for t in reversed(tiers)])
        (still if w.room else full).append(w)
    for k in range(len(tiers) - 1, -1, -1):
        tier, own = tiers[k], shelves[tiers[k]]
        below = [shelves[t] for t in reversed(tiers[:k])]
        while own:
            w = Window(tier)
            while p := own.take(w.room):
                w.add(p)
            _fill(w, below)
            if w.room and own:          # shorter tiers are empty: cut one of this tier
                _cut(w, own)
            (still if w.room else full).append(w)
    return full, still


def _fill(w: Window, shelves: list[Shelf]) -> None:
    """Whole pieces that fit, longest tiers first, then one cut to the gap."""
    for s in shelves:
        while w.room and (p := s.take(w.room)):
            w.add(p)
    for s in reversed(shelves):
        if w.room and s:
            _cut(w, s)


def _cut(w: Window, s: Shelf) -> None:
    p = s.take(s.smallest())
    w_part = min(w.room, p.length)
    w.add(Piece(p.doc, p.start, w_part))
    if w_part < p.length:
        s.put(Piece(p.doc, p.start + w_part, p.length - w_part))


def close(windows: list[Window], tiers: tuple[int, ...], least: int) -> list[Window]:
    """The last windows of a partition as sequences whose lengths are powers of two or lack less than ``least``."""
    pieces = [p for w in windows for p in w.pieces]
    total = sum(p.length for p in pieces)
    out: list[Window] = []
    at = 0                              # of the pieces laid end to end
    sizes = [tiers[-1]] * (total // tiers[-1])
    rest = total % tiers[-1]
    size = tiers[-1] // 2
    while rest:
        if size < least:
            sizes.append(rest)          # padded
            break
        if rest >= size:
            sizes.append(size)
            rest -= size
        size //= 2
    ends = np.cumsum([0, *[p.length for p in pieces]])
    for size in sizes:
        w = Window(size)
        i = int(np.searchsorted(ends, at, "right")) - 1
        while w.room:
            p, skip = pieces[i], at - int(ends[i])
            n = min(w.room, p.length - skip)
            w.add(Piece(p.doc, p.start + skip, n))
            at += n
            i += 1
        out.append(w)
    return out


def step_groups(windows: list[Window], step: int = STEP) -> list[tuple[int, int, Window]]:
    """(tier, group within it, window): groups of ``step`` tokens with about equal sums of squared lengths of pieces."""
    by: dict[int, list[Window]] = {}
    for w in windows:
        by.setdefault(1 << (w.length - 1).bit_length(), []).append(w)
    out = []
    for tier, ws in sorted(by.items()):
        each = max(1, step // tier)
        groups = -(-len(ws) // each)
        heap = [(0, g, 0) for g in range(groups)]
        cost = lambda w: sum(p.length * p.length for p in w.pieces)
        for w in sorted(ws, key=cost, reverse=True):
            c, g, held = heapq.heappop(heap)
            out.append((tier, g, w))
            if held + 1 < each:
                heapq.heappush(heap, (c + cost(w), g, held + 1))
    return out


class _Pool:
    """Documents and their ids until they are packed."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.names: list = []
        self.tokens = 0

    def add(self, name, ids: np.ndarray) -> int:
        self.names.append(name)
        self.ids.append(ids)
        self.tokens += len(ids)
        return len(self.ids) - 1


def pack_documents(docs: DataFrame, vocab_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, pool: int = POOL,
                   least: int = LEAST, step: int = STEP, ident: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: ident, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group and, on request, ids.

    A document is its text's ids and ``end_id``; null text is empty.  ``tier`` is the length that a sequence is padded
    to in its step group: its own if that is a power of two.  A step group belongs to one partition and pool.  Null or
    repeated idents are documents of their own, extra columns are ignored, and no documents give no pieces.
    """
    if any(b != 2 * a for a, b in zip(tiers, tiers[1:])) or tiers[0] & (tiers[0] - 1) or least > tiers[-1]:
        raise ValueError("tiers are powers of two, each the double of the one before")
    kind = docs.schema[ident].dataType.simpleString()
    names = [ident, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    longs = ", ".join(f"{n} long" for n in names[1:9])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = packed(vocab_path)
        tail = np.array([end_id], "<u4")
        base = TaskContext.get().partitionId() << SHIFT
        made = groups = 0
        kept: dict[int, list] = {}          # ids of the documents in waiting windows
        waiting: list[Window] = []
        held, type_ = _Pool(), None

        def emit(windows: list[Window], source: _Pool) -> Iterator[pa.RecordBatch]:
            nonlocal made, groups
            sorted_ = step_groups(windows, step)
            numbers: dict[tuple[int, int], int] = {}
            for at in range(0, len(sorted_), 2048):
                rows, ids = [], []
                for tier, g, w in sorted_[at:at + 2048]:
                    group = numbers.setdefault((tier, g), groups + len(numbers))
                    offset = 0
                    for p in w.pieces:
                        whole = source.ids[p.doc]
                        mine = whole[p.start:p.start + p.length]
                        rows.append((source.names[p.doc], p.start, p.length, zlib.crc32(mine), len(whole), base + made, offset, tier, base + group))
                        if with_ids:
                            ids.append(pa.array(mine.astype("i4")))
                        offset += p.length
                    made += 1
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), [type_, *[pa.int64()] * 8])]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.concat_arrays(ids)))
                yield pa.RecordBatch.from_arrays(cols, names)
            groups += len(numbers)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            full, rests = [], []
            for i, x in enumerate(held.ids):
                if i in kept:               # waited: its pieces are in windows
                    continue
                whole, rest = route(i, len(x), tiers)
                full += whole
                rests += [rest] if rest else []
            done, waiting = pack(rests, waiting, tiers)
            full += done
            if last:
                full += close(waiting, tiers, least)
                waiting = []
            yield from emit(full, held)
            # documents with a piece in a waiting window move on with it
            fresh, new = _Pool(), {}
            for w in waiting:
                for p in w.pieces:
                    if p.doc not in new:
                        new[p.doc] = fresh.add(held.names[p.doc], held.ids[p.doc])
                    p.doc = new[p.doc]
            kept.clear()
            kept.update({i: None for i in new.values()})
            fresh.tokens = 0
            held = fresh

        for b in batches:
            type_ = b.column("i").type
            texts, idents = b.column("t").to_pylist(), b.column("i").to_pylist()
            lo = total = 0
            for hi in range(1, len(texts) + 1):
                total += len(texts[hi - 1] or "")
                if hi < len(texts) and hi - lo < 512 and total + len(texts[hi] or "") <= CHARS:
                    continue
                for name, x in zip(idents[lo:hi], enc.encode_batch(texts[lo:hi])):
                    held.add(name, np.concatenate([np.frombuffer(x, "<u4"), tail]))
                lo, total = hi, 0
                if held.tokens >= pool:
                    yield from flush(False)
        if held.ids:
            yield from flush(True)

    return (docs.select(F.col(ident).alias("i"), F.col(text).alias("t"))
            .mapInArrow(work, f"`{ident}` {kind}, {longs}" + ", ids array<int>" * with_ids))
