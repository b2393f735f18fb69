"""Benchmark decontamination: short test items inside long documents.

Containment search by MinHash, partitioned by item size.  An item's five-word
shingles are ranked by hash, and its signature is the bottom of that order: in
the partition of items of up to U shingles, the ``U - ceil(threshold * U) + 1``
smallest.  A document that contains ``threshold`` of an item's shingles lacks at
most U - ceil(threshold * U) of them, so it holds a signature value for certain;
no candidate is lost.  Documents are not sketched: a 20-word item in a 20,000
word document has a Jaccard similarity of 0.001, which no signature of fair size
resolves.  Candidates are verified by exact shingle containment.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import fresh
from telemetra.session import materialize

WORDS = 5
#: Item shingles that may be broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, wherever the optimizer puts the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles_of(words: Column, k: int = WORDS) -> Column:
    """Distinct k-word shingles, space-joined; a text of fewer words has none."""
    def use(w):
        at = F.sequence(F.lit(1), F.size(w) - (k - 1))
        return F.when(F.size(w) >= k, F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice(w, i, k))))
                      ).otherwise(F.array().cast("array<string>"))
    return bound(words, use)


def hashes_of(words: Column, k: int = WORDS) -> Column:
    """A hash per shingle position, from the words alone."""
    def use(w):
        at = F.sequence(F.lit(0), F.size(w) - k)
        return F.when(F.size(w) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
                      ).otherwise(F.array().cast("array<bigint>"))
    return bound(words, use)


def item_signatures(items: DataFrame, item_id: str, item_text: str, threshold: float, k: int) -> DataFrame:
    """(item, part, n, h): the bottom-of-order MinHash signature of every item with k words or more."""
    w = items.select(F.col(item_id).alias("item"), words_of(F.col(item_text)).alias("w"))
    h = w.select("item", F.sort_array(F.array_distinct(hashes_of(F.col("w"), k))).alias("hs")).filter(F.size("hs") > 0)
    part = F.ceil(F.log2(F.size("hs").cast("double"))).cast("int")
    upper = F.pow(F.lit(2.0), F.col("part"))
    most = F.least(F.size("hs"), (upper - F.ceil(upper * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))
    return (h.withColumn("part", part).withColumn("sig", F.slice("hs", 1, most))
            .select("item", "part", F.size("hs").alias("n"), F.explode("sig").alias("h")))


def contaminated(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8, k: int = WORDS) -> DataFrame:
    """(ident, item id, n_shared, n_shingles, containment) for containment of at least ``threshold``.

    One row per document and item, however often either row is repeated.  Items
    of fewer than ``k`` words have no shingle and match nothing; null texts are
    empty; rows with a null id are matched too and return with it.
    """
    sig = materialize(item_signatures(items, item_id, item_text, threshold, k))
    # signature rows and, for an upper bound of all their shingles, the sizes of the items
    total = sig.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).first()
    small = max(total["rows"], total["shingles"] or 0) <= BROADCAST_ROWS
    keys = sig.select("h").distinct()
    w = docs.select(F.col(ident).alias("doc"), words_of(F.col(text)).alias("w"))
    # outer, since the optimizer guards the plain form by evaluating the array twice more
    probes = w.select("doc", F.explode_outer(hashes_of(F.col("w"), k)).alias("h")).filter("h is not null")
    hits = probes.join(F.broadcast(keys) if small else keys, "h").distinct()
    cand = materialize(hits.join(F.broadcast(sig) if small else sig, "h").select("doc", "item").distinct())

    # exact containment on the shingles themselves, for the candidates only
    its = (items.select(F.col(item_id).alias("item"), F.explode(shingles_of(words_of(F.col(item_text)), k)).alias("s")).distinct())
    size = its.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))
    d = docs.select(F.col(ident).alias("doc"), F.col(text).alias("t"))
    d = d.join(cand.select("doc").distinct().withColumnRenamed("doc", "c"), F.col("doc").eqNullSafe(F.col("c")), "left_semi")
    wanted = its.select("s").distinct()
    ds = (d.select("doc", F.explode_outer(shingles_of(words_of(F.col("t")), k)).alias("s")).filter("s is not null")
          .join(F.broadcast(wanted) if small else wanted, "s", "left_semi").distinct())
    pairs = cand.join(its.withColumnRenamed("item", "i"), F.col("item").eqNullSafe(F.col("i"))).drop("i")
    shared = (pairs.alias("p").join(ds.alias("d"), F.col("p.doc").eqNullSafe(F.col("d.doc")) & (F.col("p.s") == F.col("d.s")))
              .groupBy("p.doc", "p.item").agg(F.count(F.lit(1)).alias("n_shared")))
    out = shared.join(size.withColumnRenamed("item", "i"), F.col("item").eqNullSafe(F.col("i"))).drop("i")
    return (out.filter(F.col("n_shared") >= F.col("n_shingles") * F.lit(threshold) - F.lit(1e-9))
            .select(F.col("doc").alias(ident), F.col("item").alias(item_id), "n_shared", "n_shingles",
                    F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment")))


def clean(docs: DataFrame, items: DataFrame, ident: str = "doc_id", **how) -> DataFrame:
    """The documents that contain no item."""
    bad = fresh(docs, "_bad")
    gone = contaminated(docs, items, ident, **how).select(F.col(ident).alias(bad)).distinct()
    return docs.join(gone, F.col(ident).eqNullSafe(F.col(bad)), "left_anti")
