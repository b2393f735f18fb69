"""Language identification by error-correcting output codes.

Each language has a codeword of signs.  One binary classifier per bit scores a
text by its character n-grams (hashed byte trigrams, log odds of the two sides
of the bit, learned from counts).  Decoding weighs every bit by a loss of its
margin and picks the codeword of least total loss; texts whose two best
codewords are about equally near are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of n-grams: with the codeword bits they bound the model's size.
BUCKETS = 1 << 15
#: Different labelled texts of each language to learn from at most, in expectation (a hash sample).
TRAIN_ROWS = 4_000
#: Languages learned at most, the most frequent labels: bounds the model and what reaches the driver.
LANGUAGES = 256
#: Bytes scored at once of a very long text.
CHUNK = 1 << 20
#: Difference of the two best codewords' probability below which a text is ambiguous.
MARGIN = 0.05
#: Multiplies the mean log odds of a text before the loss.
SCALE = 8.0
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Bucket of each byte trigram of the lower-cased text with a space at either end."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Signs, a row per language: exhaustive codes for up to seven, else dense random ones of distinct rows."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        columns = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1, 1 << (n - 1))]
        return np.array(columns, np.int8).T
    rng, bits = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n)))
    while True:
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if len(np.unique(m, axis=0)) == n and (np.abs(m.sum(axis=0)) < n).all():
            return m


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray       # languages x bits
    weights: np.ndarray    # buckets x bits

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds per bit over the whole text."""
        total, n, at = np.zeros(self.weights.shape[1]), 0, 0
        while at < len(text) or not n:
            g = grams(text[at:at + CHUNK])
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
            at += CHUNK
        return total / max(n, 1) * SCALE

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, ambiguous."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = np.logaddexp(0.0, -self.code * self.margins(text)).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.langs[order[0]], float(min(1.0, p[order[0]])), bool(p[order[0]] - p[order[1]] < MARGIN)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows: at most about ``train_rows`` different texts of each language, chosen by a hash.

    Every language has its own share, so a rare one keeps all its rows however
    large the table is; texts that repeat within a language count once.  A text
    labelled with several languages counts for each.  Labels beyond the
    ``LANGUAGES`` most frequent (ties: smaller first) are not learned.  Counts of
    (language, bucket) are summed by Spark; what reaches the driver is at most
    ``LANGUAGES`` x ``BUCKETS`` numbers.  Rows with a null text or language are
    passed over; without any, the model has no language.
    """
    rows = rows.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    sizes = (rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("t")).alias("d"))
             .orderBy(F.desc("n"), "l").limit(LANGUAGES).collect())
    share = {r["l"]: min(1.0, train_rows / max(1, r["d"])) for r in sizes}
    cut = F.lit(None).cast("long")
    if share:
        cut = F.create_map(*[F.lit(x) for l_, s in sorted(share.items()) for x in (l_, int(1_000_000 * s))])[F.col("l")]
    # an unknown label has no cut and goes
    rows = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < cut).distinct()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang_ in zip(b.column("t").to_pylist(), b.column("l").to_pylist()):
                own = counts.setdefault(lang_, np.zeros(BUCKETS))
                g = np.bincount(grams(t), minlength=BUCKETS)
                own += g / max(1, g.sum())          # every text has the same say
        for lang_, own in counts.items():
            at = own.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["l", "g", "c"])

    total = rows.mapInArrow(work, "l string, g int, c double").groupBy("l", "g").agg(F.sum("c").alias("c"))
    packed = total.groupBy("l").agg(F.collect_list(F.struct("g", "c")).alias("x")).collect()
    langs = sorted(r["l"] for r in packed)
    dist = np.zeros((len(langs), BUCKETS))
    for r in packed:
        own = dist[langs.index(r["l"])]
        for x in r["x"]:
            own[x["g"]] = round(x["c"], 9)          # the order of summing must not show
        own /= max(own.sum(), 1e-12)
    dist = dist + 1e-7
    code = codewords(len(langs))
    w = np.zeros((BUCKETS, code.shape[1]))
    for j in range(code.shape[1]):
        side = code[:, j] > 0
        w[:, j] = np.log(dist[side].mean(axis=0)) - np.log(dist[~side].mean(axis=0))
    return Model(langs, code, w.astype(np.float32))


def predict(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, lang_pred, score, ambiguous) for every whole text.

    The model is shipped once per executor; its size is fixed by BUCKETS and the
    code length.  A null text or one without letters is ``und`` with score 0.
    """
    kind = docs.schema[ident].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column("t").to_pylist()]
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("i"), *cols], [ident, "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInArrow(
        work, f"`{ident}` {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(ident: str = "doc_id") -> F.Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from_documents(docs: DataFrame) -> Model:
    """The model of the given table: learned from its rows with a language that are not held out."""
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
