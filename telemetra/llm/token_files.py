"""Token ids as length-delimited binary records with an offset index.

A record is ``length u64 | masked crc of length u32 | payload | masked crc of
payload u32 | newline``, all little-endian; the payload is ``doc_id i64 | bytes of an
id u32 | n u32 | n ids``.  Ids take two bytes if the vocabulary fits them, else
four.  A null doc_id is written as the smallest long.  Shards are
written and read by Spark alone, on any file system it knows: a lost task is
written again and only committed files count.  The index (doc_id, shard, offset,
length, n_tokens, start in the shard, crc32) is made by reading the shards back.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemetra.llm.bpe import ROOM, Vocabulary
from telemetra.llm.common import Memo
from telemetra.session import shared_path

#: Rotation and constant of the masked checksum.
MASK_SHIFT, MASK_ADD = 15, 0xA282EAD8
NO_ID = -(1 << 63)
#: Documents in a file at most, and bytes of a file, so that it can be read whole.
RECORDS_PER_FILE, FILE_BYTES = 20_000, 1 << 30
#: Bytes that normalisation makes of one byte at most; an id stands for at least one.
GROWTH = 3
#: Characters encoded together.
CHARS = 4_000_000


def masked(data: bytes) -> int:
    """CRC-32 turned and shifted, so that a checksum over data holding checksums stays sound."""
    c = zlib.crc32(data)
    return (((c >> MASK_SHIFT) | (c << (32 - MASK_SHIFT))) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """A record of ids given as unsigned 32-bit integers and written in ``width`` bytes each."""
    n = len(ids) // 4
    if width != 4:
        ids = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()
    body = struct.pack("<qII", NO_ID if doc_id is None else doc_id, width, n) + ids
    size = struct.pack("<Q", len(body))
    return b"".join((size, struct.pack("<I", masked(size)), body, struct.pack("<I", masked(body)), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each record of a shard; a broken one raises."""
    at, view = 0, memoryview(data)
    while at < len(view):
        size = bytes(view[at:at + 8])
        n, crc = struct.unpack("<QI", view[at:at + 12])
        if crc != masked(size) or at + 17 + n > len(view):
            raise ValueError(f"broken record length at {at}")
        body = view[at + 12:at + 12 + n]
        (crc,) = struct.unpack("<I", view[at + 12 + n:at + 16 + n])
        if crc != masked(body):
            raise ValueError(f"broken record at {at}")
        doc, width, k = struct.unpack("<qII", body[:16])
        if width not in (2, 4) or len(body) != 16 + width * k:
            raise ValueError(f"record at {at} holds another number of ids than it says")
        yield at, 17 + n, None if doc == NO_ID else doc, np.frombuffer(body[16:], f"<u{width}").astype("<u4")
        at += 17 + n


def read_record(data: bytes, offset: int, length: int) -> tuple[int | None, list[int]]:
    """One record through its index entry."""
    _, _, doc, ids = next(frames(data[offset:offset + length]))
    return doc, ids.tolist()


class Packed:
    """Texts to packed ids by the model of the tokenizers library, asked once for each distinct word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path).model
        self.rules = Vocabulary(path)
        self.chunks = Memo(self.chunk, ROOM)

    def word(self, word: str) -> bytes:
        symbols = self.rules.symbols
        ids = [t.id for t in self.lib.tokenize("".join([symbols[b] for b in word.encode("utf-8", "replace")]))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, chunk: str) -> bytes:
        return self.word(chunk) if chunk.isalpha() else b"".join(map(self.word, self.rules.pieces.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        """As the library encodes the whole text: no merge crosses the bounds of a piece."""
        out: list[bytes] = []
        for special, s in self.rules.parts_of(text or ""):
            if special:
                out.append(struct.pack("<I", self.rules.special[s]))
            else:
                out.extend(self.rules.encoded(s, self.chunks.__getitem__, self.word))
        return b"".join(out)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; each distinct chunk of the batch is looked up once."""
        odd = self.rules.specials
        plain = ["" if not t else None if odd and odd.search(t) else self.rules.spaced(t) for t in texts]
        alone = [p is None for p in plain]
        lists = pc.utf8_split_whitespace(pa.array([p or "" for p in plain], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        known = [self.chunks[w] if w else b"" for w in coded.dictionary.to_pylist()]
        pool = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        return [self.encode(t) if x else ids[a:b].tobytes() for t, x, a, b in zip(texts, alone, cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def packed(path: str) -> Packed:
    return Packed(path)


def records_per_file(longest: int) -> int:
    """Records of texts of up to ``longest`` bytes that fit a file for certain, with ids of four bytes."""
    return max(1, min(RECORDS_PER_FILE, FILE_BYTES // (4 * GROWTH * longest + 64)))


def write_shards(docs: DataFrame, vocab_path: str, out: str, end_id: int | None = 2,
                 ident: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the records in ascending order of ident.

    Rows are dealt by ranges of ident, so file names ascend with it; equal idents
    are ordered by text.  Null text is empty: its record holds the end id alone.
    The longest text tells how many records keep a file below ``FILE_BYTES``; a
    record that is larger than that alone has a file of its own.
    """
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = packed(vocab_path)
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        width = 2 if max(enc.rules.tokens, default=0) < 1 << 16 > (end_id or 0) else 4
        for b in batches:
            # of at most 512 rows and, a single row apart, about CHARS characters
            texts, ids = b.column("t").to_pylist(), b.column("i").to_pylist()
            lo = total = 0
            for hi in range(1, len(texts) + 1):
                total += len(texts[hi - 1] or "")
                if hi < len(texts) and hi - lo < 512 and total + len(texts[hi] or "") <= CHARS:
                    continue
                rec = [frame(i, x + tail, width)[:-1] for i, x in zip(ids[lo:hi], enc.encode_batch(texts[lo:hi]))]
                yield pa.RecordBatch.from_arrays([pa.array(rec, pa.binary())], ["r"])
                lo, total = hi, 0

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(ident).cast("long").alias("i"), F.col(text).alias("t"))
    longest = rows.agg(F.max(F.octet_length("t"))).first()[0] or 0
    (rows.repartitionByRange(n, "i").sortWithinPartitions("i", "t").mapInArrow(work, "r binary")
     .select(F.col("r").cast("string").alias("value")).write.option("lineSep", "\n")
     .option("maxRecordsPerFile", records_per_file(longest)).text(out))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the shards, checked against both checksums.

    doc_id, shard, offset, length, n_tokens, start (ids before it in its shard), ids_crc32.
    """
    names = ["doc_id", "shard", "offset", "length", "n_tokens", "start", "ids_crc32"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("content")):
                rows, start = [], 0
                for offset, length, doc, ids in frames(data.as_buffer()):
                    rows.append((doc, shard, offset, length, len(ids), start, zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if rows:
                    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("shard"), "content"))
    return files.mapInArrow(work, "doc_id long, shard string, offset long, length long, n_tokens long, start long, ids_crc32 long")


def write_token_files(docs: DataFrame, vocab_path: str, path: str | None = None, end_id: int | None = 2) -> tuple[str, DataFrame]:
    """Shards below ``path``/shards and their index below ``path``/index; returns the path and the index.

    The index also holds ``start``: the ids of all records before, over all shards.
    An empty table writes no record and an empty index.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_shards(docs, vocab_path, f"{path}/shards", end_id)
    read_shards(spark, f"{path}/shards").write.parquet(f"{path}/records")
    rec = spark.read.parquet(f"{path}/records")
    # one row per shard, far fewer than records
    before = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    base = (rec.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
            .select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    index = rec.join(base, "shard").withColumn("start", F.col("start") + F.col("_base")).drop("_base")
    return path, index
