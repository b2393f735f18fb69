"""Spelling variants: words one edit apart, found with a bit-sliced position index.

The index of a list of words holds, for each (position, letter), the set of words
with that letter there, as one long integer with a bit per word.  A query word is
read letter by letter.  Sets are carried for all words at once: those equal so
far, and those with one replaced, one missing or one extra letter, whose
positions are shifted against the query's by 0, -1 and +1.  Each step is a few
ANDs and ORs of whole sets.

Words meet in buckets.  Of a word and a longer or equal one of M letters, the
first difference lies in some stretch [a, b) of the longer word; before a and
after b both agree.  So a bucket is named by M, the stretch and the letters
around it, starting with both halves.  A bucket that is too full is divided by
halving its stretch, down to one letter, where it holds no more words than there
are letters.  A pair is found in the one bucket whose stretch holds its first
difference, so that near words can be counted without listing pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import run_bounds, runs
from telemetra.session import materialize

#: What a word is made of, and the letters that are lowered.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words of a bucket beyond which it is divided, and of the small buckets that share an index.
FULL, SHARED = 4096, 1024
#: Different words counted together before they leave a task.
HELD = 200_000
MAX_JUMPS = 64


def mutated(doc_id: int | None, word: str, every: int = 97) -> str:
    """The word, or if ``every`` divides the checksum h of ``doc_id:word``, the word without its letter h % length."""
    h = zlib.crc32(word.encode("utf-8"), zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":"))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3,
                every: int | None = 97) -> DataFrame:
    """(word, n) over all whole texts.  ``every=None`` leaves the words as they are.

    Null and wordless texts add nothing, repeated rows count again; a null ident has an empty number.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                if not t:
                    continue
                words = Counter(RUN.findall(t.lower() if t.isascii() else t.translate(LOWER)))
                if every is None:
                    held.update(words)
                else:
                    start = zlib.crc32(b"%d:" % i if i is not None else b":")
                    for w, n in words.items():
                        h = zlib.crc32(w.encode(), start)
                        if h % every == 0:
                            w = w[:h % len(w)] + w[h % len(w) + 1:]
                        held[w] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    parts = docs.select(F.col(ident).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(work, "word string, n long")
    return (parts.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least_count))


class Index:
    """Sets of words by (position, letter), as integers with bit i for word i."""

    def __init__(self, words: list[str]):
        self.words, self.all = words, (1 << len(words)) - 1
        size = np.array([len(w) for w in words])
        self.longest = int(size.max(initial=0))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        first = np.cumsum(size) - size
        self.at: list[dict[str, int]] = []
        self.size: dict[int, int] = {int(n): self.bits((size == n).nonzero()[0]) for n in np.unique(size)}
        for p in range(self.longest):
            has = (size > p).nonzero()[0]
            letters = flat[first[has] + p]
            order = np.argsort(letters, kind="stable")
            cuts = np.flatnonzero(np.diff(letters[order])) + 1
            self.at.append({chr(letters[g[0]]): self.bits(has[g]) for g in np.split(order, cuts)})

    def bits(self, members: np.ndarray) -> int:
        b = np.zeros(len(self.words), np.uint8)
        b[members] = 1
        return int.from_bytes(np.packbits(b, bitorder="little").tobytes(), "little")

    def letter(self, p: int, c: str) -> int:
        return self.at[p].get(c, 0) if p < self.longest else 0

    def near(self, word: str, among: int, long: int, a: int, b: int) -> int:
        """The set of words of ``among`` exactly one edit from ``word``, the longer of both having ``long`` letters.

        They first differ at a place in [a, b).
        """
        n = len(word)
        same, changed, less, more = among, 0, 0, 0
        letter = self.letter
        if n < long:                            # only words with one letter more are sought
            for i, c in enumerate(word):
                here, ahead = letter(i, c), letter(i + 1, c)
                more &= ahead
                if a <= i < b:
                    more |= same & ~here & ahead
                same &= here
                if not (same or more):
                    return 0
            return (more | same if a <= n < b else more) & self.size.get(long, 0)
        for i, c in enumerate(word):
            here = letter(i, c)
            # words without a letter of the query stand one place behind
            less &= letter(i - 1, c) if i else 0
            changed &= here
            if a <= i < b and (other := same & ~here):
                less |= other
                changed |= other
            same &= here
            if not (same or changed or less):
                return 0
        return (changed & self.size.get(n, 0)) | (less & self.size.get(n - 1, 0))

    def members(self, found: int) -> list[int]:
        out = []
        while found:
            low = found & -found
            out.append(low.bit_length() - 1)
            found ^= low
        return out


def _bucket(long: str, a: str, b: str) -> str:
    """The bucket of a stretch [a, b) of the longer word: its length, the stretch and the letters of ``word`` around it."""
    return f"xxhash64({long}, {a}, {b}, left(word, {a}), right(word, greatest({long} - {b}, 0)))"


def memberships(words: DataFrame, full: int = FULL) -> DataFrame:
    """(bucket, m, a, b, word, n): every word in the buckets in which its near words are."""
    made = words.select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    zero = F.lit(0)
    made = made.select("*", F.explode(F.array(F.struct(zero.alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("m").alias("b")))).alias("s"))
    rest = made.select("word", "n", "m", "s.a", "s.b").withColumn("bucket", F.expr(_bucket("m", "a", "b")))
    out = None
    while True:
        sizes = materialize(rest.groupBy("bucket", "a", "b").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"))
        many = sizes.filter((F.col("held") > full) & (F.col("b") - F.col("a") > 1))
        more = bool(many.limit(1).count())
        fit = sizes.filter((F.col("held") <= full) | (F.col("b") - F.col("a") <= 1)) if more else sizes
        kept = rest.join(fit.select("bucket"), "bucket", "left_semi").select("bucket", "m", "a", "b", "word", "n")
        out = kept if out is None else out.unionByName(kept)
        if not more:
            return out
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        cut = F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))).alias("s")
        rest = materialize(rest.join(many.select("bucket"), "bucket", "left_semi").select("word", "n", "m", cut)
                           .select("word", "n", "m", "s.a", "s.b").withColumn("bucket", F.expr(_bucket("m", "a", "b"))))


def _search(shared: int):
    keys = ["bucket"]

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
        """Whole buckets, together about as many words as an index takes."""
        held: list[pa.Table] = []
        for t in runs(batches, keys):
            held.append(t)
            if sum(x.num_rows for x in held) >= shared:
                t = pa.concat_tables(held)
                yield t, run_bounds(t, keys)
                held = []
        if held:
            t = pa.concat_tables(held)
            yield t, run_bounds(t, keys)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in groups(batches):
            first = 0
            while first < len(bounds):
                last = first + 1
                while last < len(bounds) and bounds[last][1] - bounds[first][0] <= shared:
                    last += 1
                yield _near_in(t, bounds[first:last])
                first = last

    return work


def _near_in(t: pa.Table, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
    start, end = bounds[0][0], bounds[-1][1]
    t = t.slice(start, end - start)
    words, counts = t.column("word").to_pylist(), t.column("n").to_pylist()
    m, a, b = (t.column(x).to_pylist() for x in ("m", "a", "b"))
    index = Index(words)
    out = ([], [], [], [])
    for lo, hi in bounds:
        lo, hi = lo - start, hi - start
        among = ((1 << (hi - lo)) - 1) << lo
        for i in range(lo, hi):
            if found := index.near(words[i], among, m[i], a[i], b[i]):
                near = index.members(found)
                best = min(near, key=lambda j: (-counts[j], words[j]))
                for col, v in zip(out, (words[i], len(near), counts[best], words[best])):
                    col.append(v)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["word", "near", "best_n", "best"])


def near_words(words: DataFrame, full: int = FULL) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have near words in a table of distinct (word, n).

    ``best`` has the largest n, of equal ones the first in code-point order.
    """
    dealt = memberships(words, full).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.select("bucket", "m", "a", "b", "word", "n").mapInArrow(_search(SHARED), "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("k"), "best"))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("t"))
            .select("word", "n_near", F.col("t.best").alias("best"), (-F.col("t.k")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) end, by doubling; a link leads to a larger count, so there is no circle."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(MAX_JUMPS):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return at
    raise RuntimeError("forms did not settle")


def variants(words: DataFrame, factor: int = 2, full: int = FULL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct (word, n).

    A word's form is its near word of largest n, if that is at least ``factor``
    (2 or more) times its own.  Words without letters in common with others return too; an
    empty table gives none.  Null words have no place in the table.
    """
    words = materialize(words)
    formed = (words.join(near_words(words, full), "word", "left")
              .withColumn("is", F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False)))
              .select("word", F.when(F.col("is"), F.col("best")).alias("form"), "n",
                      F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is"), F.col("best_n")).alias("form_n")))
    formed = materialize(formed)
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
