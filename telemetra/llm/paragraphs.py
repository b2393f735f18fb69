"""Repeated passages: paragraph MinHash, banding, exact verification, components.

Equal paragraphs are combined by a 128-bit hash of their words before anything
is compared.  Different ones collide in bands of MinHash values; the bands are
tuned so that a pair at the threshold meets with the wanted recall.  Band buckets
with equal members are looked at once.  Whole texts are grouped by SimHash before
that, and the bands look only for links between what these groups leave apart.
In each bucket or group a breadth-first search
verifies pairs by exact Jaccard similarity of their word shingles and emits a
spanning forest.  Components of the links are the clusters; the first occurrence
(smallest document, then paragraph) stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import Memo, fresh, let_go, run_bounds, runs, split_cells
from telemetra.llm import passages, simhash
from telemetra.llm.components import connected_components
from telemetra.session import materialize

WORD = re.compile(r"\w+")
#: Shingles hashed at once per permutation: the working set stays in cache.
CHUNK = 1 << 15
WORD_ROOM = 300_000
#: Shingles of a bucket from which their sets are compared as arrays: a Python set takes ten times the memory.
ARRAYS = 1 << 13


#: Share of line pairs at the threshold that meet in a band.
LINE_RECALL = 0.98


def tune_bands(threshold: float = 0.8, recall: float = 0.9999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the longest bands that reach the recall at the threshold with ``most`` values."""
    best = (most, 1)
    for rows in range(1, most + 1):
        alike = threshold ** rows               # chance that one band agrees
        bands = 1 if alike >= recall else math.ceil(math.log1p(-recall) / math.log1p(-alike)) if alike > 1e-9 else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Hasher:
    """Word, shingle and MinHash values; memory is bounded by the number of words kept."""

    def __init__(self, words: int, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k, self.bands, self.rows = words, bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, words, dtype=np.uint64) | np.uint64(1)
        self.word = Memo(lambda w: xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass")), WORD_ROOM)

    def shingles(self, words: list[str]) -> np.ndarray:
        """Distinct shingle hashes, sorted; fewer than k words are one shingle."""
        return self.shingles_of(self.hashes(words))

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))

    def shingles_of(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return w
        k = min(self.k, len(w))
        n = len(w) - k + 1
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = (h ^ (w[j:j + n] * self.mix[j])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)

    def shingles_of_all(self, units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all units, given as hashes of words, one after another; and where each unit's start."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        if size.min() < self.k:                       # short units are one shingle
            sets = [self.shingles_of(u) for u in units]
            return np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        w = np.concatenate(units)
        n, end = len(w) - self.k + 1, np.cumsum(size)
        h = np.zeros(n, np.uint64)
        for j in range(self.k):
            h = (h ^ (w[j:j + n] * self.mix[j])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = np.ones(len(w), bool)
        for j in range(1, self.k):
            inside[end - j] = False
        return h[inside[:n]], np.concatenate([[0], np.cumsum(size - self.k + 1)[:-1]])

    def signatures(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One band key per set and band; ``flat`` holds the sets one after another."""
        out = np.full((len(starts), self.bands * self.rows), np.iinfo(np.uint64).max, np.uint64)
        first, ends = 0, np.append(starts[1:], len(flat))
        while first < len(starts):                    # sets of about CHUNK shingles together
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, "right")))
            part, at = flat[starts[first]:ends[last - 1]], starts[first:last] - starts[first]
            for i in range(len(self.a)):
                x = part * self.a[i] + self.b[i]
                out[first:last, i] = np.minimum.reduceat(x >> np.uint64(16), at)
            first = last
        keys = np.zeros((len(starts), self.bands), np.uint64)
        for r in range(self.rows):
            keys = (keys ^ out[:, r::self.rows]) * np.uint64(0xC2B2AE3D27D4EB4F)
            keys ^= keys >> np.uint64(31)
        return (keys + np.arange(self.bands, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def paragraph_words(text: str | None, min_words: int) -> Iterator[tuple[int, list[str]]]:
    """(number, words) of every line of the text with at least ``min_words`` words."""
    for no, line in enumerate((text or "").split("\n")):
        if len(line) >= 2 * min_words - 1:
            w = WORD.findall(line)
            if len(w) >= min_words:
                yield no, w


def whole_text(text: str | None, min_words: int) -> Iterator[tuple[int, list[str]]]:
    """(0, words) of the text as one unit, split at white space; texts without a word are copies of each other."""
    w = (text or "").lower().split() or [""]
    if len(w) >= min_words:
        yield 0, w


def content_id(words: list[str]) -> bytes:
    """Of the words in lower case."""
    return xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))


def paragraphs(docs: DataFrame, ident: str, text: str, min_words: int, words: int, bands: int, rows: int,
               units=paragraph_words) -> DataFrame:
    """(doc, para, n_words, pid, keys, fp): every paragraph with its content id, band keys and SimHash of its shingles."""
    kind = docs.schema[ident].dataType.simpleString()
    names = ["doc", "para", "n_words", "pid", "keys", "fp"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        h = Hasher(words, bands, rows)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                c = b.slice(at, 128)
                row, para, n, pid, held = [], [], [], [], []
                for i, t in enumerate(c.column("t").to_pylist()):
                    for no, w in units(t, min_words):
                        row.append(i)
                        para.append(no)
                        n.append(len(w))
                        pid.append(content_id(w))
                        held.append(h.hashes(w))
                if not row:
                    continue
                sets = h.shingles_of_all(held)
                keys = h.signatures(*sets).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [c.column("i").take(pa.array(row)), pa.array(para, pa.int32()), pa.array(n, pa.int32()),
                     pa.array(pid, pa.binary()), flat, pa.array(simhash.majorities(*sets).view(np.int64))], names)

    return docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInArrow(
        work, f"doc {kind}, para int, n_words int, pid binary, keys array<long>, fp long")


def paragraphs_and_windows(docs: DataFrame, ident: str, text: str, min_words: int, words: int, bands: int, rows: int) -> DataFrame:
    """The rows of ``paragraphs`` (with a pid) and one row with all windows of each text (lists at, id), from one reading."""
    kind = docs.schema[ident].dataType.simpleString()
    longs = pa.list_(pa.int64())
    names = ["doc", "para", "n_words", "pid", "keys", "at", "id"]
    kinds = [None, pa.int32(), pa.int32(), pa.binary(), longs, longs, longs]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        h, cut = Hasher(words, bands, rows), passages.Windows()
        for b in batches:
            for at in range(0, b.num_rows, 128):
                c = b.slice(at, 128)
                row, para, n, pid, held, found = [], [], [], [], [], []
                for i, t in enumerate(c.column("t").to_pylist()):
                    lines = [WORD.findall(x) for x in (t or "").split("\n")]
                    w = h.hashes([x for line in lines for x in line])
                    found.append(cut(w))
                    start = 0
                    for no, line in enumerate(lines):
                        if len(line) >= min_words:
                            row.append(i)
                            para.append(no)
                            n.append(len(line))
                            pid.append(content_id(line))
                            held.append(w[start:start + len(line)])
                        start += len(line)
                if row:
                    keys = h.signatures(*h.shingles_of_all(held)).view(np.int64)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [c.column("i").take(pa.array(row)), pa.array(para, pa.int32()), pa.array(n, pa.int32()),
                         pa.array(pid, pa.binary()), flat, *[pa.nulls(len(row), longs)] * 2], names)
                ends = pa.array(np.cumsum([0, *[len(x[0]) for x in found]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(
                    [c.column("i"), *[pa.nulls(len(found), k) for k in kinds[1:5]], *lists], names)

    return docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInArrow(
        work, f"doc {kind}, para int, n_words int, pid binary, keys array<long>, at array<long>, id array<long>")


def _shingle_table(docs: DataFrame, ident: str, text: str, min_words: int, words: int, units=paragraph_words) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        h = Hasher(words, 1, 1)
        for b in batches:
            for t in b.column("t").to_pylist():
                got = {content_id(w): h.shingles(w) for _, w in units(t, min_words)}
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(got), pa.binary()), pa.array([s.view(np.int64) for s in got.values()], pa.list_(pa.int64()))],
                        ["pid", "s"])

    return docs.select(F.col(text).alias("t")).mapInArrow(work, "pid binary, s array<long>")


def _forest(flat: np.ndarray, size: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets that stand one after another in ``flat``; memory as that of the sets."""
    codes = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    out, left, held = [], np.arange(1, len(size)), codes[size[0]:]
    queue = [0]
    while queue or len(left):
        if not queue:
            queue, held, left = [int(left[0])], held[size[left[0]]:], left[1:]
        at = queue.pop()
        if not len(left):
            break
        mine = codes[ends[at] - size[at]:ends[at]]
        mark[mine] = True
        both = np.diff(np.concatenate([[0], np.cumsum(mark[held])])[np.concatenate([[0], np.cumsum(size[left])])])
        mark[mine] = False
        hit = both >= threshold * (size[at] + size[left] - both) - 1e-9
        if hit.any():
            out += [(at, j) for j in left[hit].tolist()]
            queue += left[hit].tolist()
            held, left = held[np.repeat(~hit, size[left])], left[~hit]
    return out


def _verify(threshold: float):
    keys = ["cell", "_lo", "_hi"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for t in runs(batches, keys):
            us, vs = [], []
            for a, b in run_bounds(t, keys):
                part = t.slice(a, b - a)
                pids = part.column("pid").to_pylist()
                s = part.column("s").combine_chunks()
                if len(s.flatten()) > ARRAYS:
                    for i, j in _forest(s.flatten().to_numpy(), s.value_lengths().to_numpy(), threshold):
                        us.append(pids[i])
                        vs.append(pids[j])
                    continue
                sets = [frozenset(x) for x in s.to_pylist()]
                left, queue = list(range(1, len(pids))), [0]
                while queue or left:
                    if not queue:
                        queue = [left.pop()]
                    at = queue.pop()
                    mine, rest = sets[at], []
                    for j in left:
                        if min(len(mine), len(sets[j])) < threshold * max(len(mine), len(sets[j])) - 1e-9:
                            rest.append(j)
                            continue
                        both = len(mine & sets[j])
                        if both >= threshold * (len(mine) + len(sets[j]) - both) - 1e-9:
                            us.append(pids[at])
                            vs.append(pids[j])
                            queue.append(j)
                        else:
                            rest.append(j)
                    left = rest
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return work


def fingerprint_groups(content: DataFrame, distance: int) -> DataFrame:
    """(cell, id): the contents (id, fp) whose SimHashes are linked by steps of at most ``distance`` bits, in groups of two or more."""
    near = simhash.links(content.select("fp").distinct(), distance)
    roots = connected_components(near).withColumnRenamed("node", "fp")
    grouped = content.select("id", "fp").join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("cell"), "id")
    many = grouped.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    return grouped.join(many, "cell")


def repeated_paragraphs(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_words: int = 40,
                        words: int = 5, threshold: float = 0.8, recall: float = 0.9999, units=paragraph_words,
                        found: DataFrame | None = None, distance: int | None = None) -> DataFrame:
    """(ident, para, n_words, cluster, kept_id, kept_para, removed) for every paragraph that occurs again.

    A paragraph is a line; ``para`` counts from 0 within ``text.split('\\n')``.
    Lines of fewer than ``min_words`` words take no part, so short stock phrases
    stay.  Rows that repeat an ident and its text are one document.  Null texts
    have no paragraphs.  A null ident orders first.  Extra columns are ignored.
    ``found`` gives the rows of ``paragraphs`` where they are stored already.
    With a ``distance``, paragraphs are first grouped by SimHash links of at most so many bits and
    verified inside the groups; the bands then look only for links between paragraphs that stay apart.
    """
    bands, rows = tune_bands(threshold, recall)
    occ = materialize(paragraphs(docs, ident, text, min_words, words, bands, rows, units)) if found is None else found
    first = F.min(F.struct("doc", "para"))
    # in the bands a content is a 64-bit hash, half as wide; its exact id returns with the shingles
    content = materialize(occ.groupBy("pid").agg(first.alias("at"), F.first("keys").alias("keys"),
                                                 *([] if distance is None else [F.first("fp").alias("fp")]))
                          .withColumn("id", F.xxhash64("pid")))

    def verified(met: DataFrame) -> DataFrame:
        """Links (u, v) between the pids that share a cell; ``met`` (cell, id) is stored."""
        # shingles of what met, from the documents that hold it first
        wanted = content.join(met.select("id").distinct(), "id", "left_semi").select("id", "pid", F.col("at.doc").alias("_doc"))
        texts = docs.select(F.col(ident).alias("_id"), F.col(text).alias("t")).join(
            wanted.select("_doc").distinct(), F.col("_id").eqNullSafe(F.col("_doc")), "left_semi")
        sets = (_shingle_table(texts, "_id", "t", min_words, words, units).join(wanted.select("id", "pid"), "pid")
                .groupBy("id", "pid").agg(F.first("s").alias("s")))
        # the sets join after the members are dealt, so each task gets its own ones once
        dealt = (split_cells(met, "cell", "id").join(sets, "id").repartition("cell", "_lo", "_hi")
                 .sortWithinPartitions("cell", "_lo", "_hi", "pid"))
        return dealt.select("cell", "_lo", "_hi", "pid", "s").mapInArrow(_verify(threshold), "u binary, v binary")

    told, lead, close = content, F.col("id"), None
    if distance is not None:
        close = materialize(verified(materialize(fingerprint_groups(content, distance))))
        led = connected_components(close).select(F.col("node").alias("pid"), F.xxhash64("root").alias("lead"))
        told, lead = content.join(led, "pid", "left"), F.coalesce("lead", "id")
    member = told.select("id", lead.alias("lead"), F.explode("keys").alias("cell"))
    bucket = (member.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"),
                                         F.sum(F.col("id") % F.lit(1 << 40)).alias("all"),
                                         F.min("lead").alias("one"), F.max("lead").alias("other"))
              .filter("n > 1 and one <> other").groupBy("n", "low", "all").agg(F.min("cell").alias("cell")).select("cell"))
    # the estimates take an exploded list for one row, so neither side may be broadcast
    edges = verified(materialize(member.select("cell", "id").join(bucket.hint("merge"), "cell")))
    edges = edges if close is None else edges.unionByName(close)

    roots = connected_components(edges).withColumnRenamed("node", "pid")
    named = content.select("pid", "at").join(roots, "pid", "left").select("pid", "at", F.coalesce("root", "pid").alias("root"))
    keep = named.groupBy("root").agg(F.min("at").alias("keep"))
    cluster = named.join(keep, "root").select("pid", "root", "keep")
    again = occ.groupBy("pid").agg(F.count_distinct(F.struct("doc", "para")).alias("times"))
    clustered = (cluster.join(again, "pid").join(
        named.join(again, "pid").groupBy("root").agg(F.sum("times").alias("total")).filter("total > 1"), "root")
        .select("pid", "root", "keep"))
    out = occ.select("doc", "para", "n_words", "pid").distinct().join(clustered, "pid")
    return out.select(F.col("doc").alias(ident), "para", "n_words", F.lower(F.hex("root")).alias("cluster"),
                      F.col("keep.doc").alias("kept_id"), F.col("keep.para").alias("kept_para"),
                      (~(F.col("doc").eqNullSafe(F.col("keep.doc")) & (F.col("para") == F.col("keep.para")))).alias("removed"))


def repeated_passages(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_words: int = 40, words: int = 5,
                      threshold: float = 0.8, recall: float = LINE_RECALL) -> DataFrame:
    """All repeated text: lines, as in ``repeated_paragraphs``, and spans of words, as in ``passages.repeated_spans``.

    Columns of both; lines have no start, spans have neither para nor cluster and are always removed.
    """
    kind = docs.schema[ident].dataType.simpleString()
    bands, rows = tune_bands(threshold, recall)
    found = materialize(paragraphs_and_windows(docs, ident, text, min_words, words, bands, rows))
    units = found.filter("pid is not null").select("doc", "para", "n_words", "pid", "keys")
    lines = repeated_paragraphs(docs, ident, text, min_words, words, threshold, recall, found=units)
    lines = lines.withColumn("start", F.lit(None).cast("long")).withColumn("kept_start", F.lit(None).cast("long"))
    windows = found.filter("at is not null").select("doc", F.explode(F.arrays_zip("at", "id")).alias("w")).select("doc", "w.*")
    spans = (passages.repeated_spans(docs, ident, text, found=windows).withColumn("n_words", F.col("n_words").cast("int"))
             .withColumn("removed", F.lit(True)).withColumn("kept_id", F.col("kept_id").cast(kind)))
    return lines.unionByName(spans, allowMissingColumns=True)


def without_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without the passages that occur earlier; columns as before."""
    rows = repeated_passages(docs, ident, text, **how).filter("removed")
    key, lines, spans = (fresh(docs, x) for x in ("_doc", "_lines", "_spans"))
    span = F.when(F.col("start").isNotNull(), F.struct("start", F.col("n_words").cast("long").alias("n")))
    gone = rows.groupBy(F.col(ident).alias(key)).agg(F.collect_set("para").alias(lines), F.collect_set(span).alias(spans))
    joined = docs.join(gone, F.col(ident).eqNullSafe(F.col(key)), "left")
    at, names = docs.columns.index(text), docs.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            told = b.column(at).to_pylist()
            for i in b.column(lines).is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
                if told[i] is not None:
                    told[i] = passages.cut_text(told[i], b.column(lines)[i].as_py(), [(x["start"], x["n"]) for x in b.column(spans)[i].as_py()])
            cols = [pa.array(told, b.column(at).type) if j == at else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(work, docs.schema)


def without_near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8,
                        distance: int = 5) -> DataFrame:
    """One row of the first document of each group of texts linked by exact Jaccard similarity of their word shingles.

    SimHash links of at most ``distance`` bits group the texts first; the bands find the alike texts that differ in more bits.
    ``ident`` has no nulls.  Rows that repeat it hold the same text; they are combined where the join has put them.
    """
    key = fresh(docs, "_doc")
    gone = (repeated_paragraphs(docs, ident, text, 1, words, threshold, units=whole_text, distance=distance).filter("removed")
            .select(F.col(ident).alias(key)).distinct())
    return docs.join(gone, F.col(ident) == F.col(key), "left_anti").dropDuplicates([ident])
