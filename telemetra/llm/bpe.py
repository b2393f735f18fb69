"""Byte-pair encoding and decoding with a vocabulary file.

A short word is a contiguous array of part boundaries with the merge rank of
each adjacent pair beside it.  The smallest rank is found by scanning, its
boundary deleted, and the ranks of the two neighbours refreshed.  Words of more
than ``LONG`` symbols use a heap over a linked list instead, with equal results,
since scanning them would be quadratic.

A text is folded and cut as a whole.  Merges never leave a piece, so each
distinct word is encoded once per worker while its bounded memory has room.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.llm.common import Memo, held

LONG = 64
ROOM = 500_000
NONE = 1 << 60
#: Classes of characters: white space, letter or number, symbol, what only str.split takes for space, stop or comma,
#: and what Python's tables do not know, which the library may have for a letter.
SPACE, WORD, SYMBOL, CONTROL, STOP, UNKNOWN = 0, 1, 3, 4, 5, 7


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is visible Latin-1, else the next free code from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in seen}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(seen)))
    return [out[b] for b in range(256)]


def fold(text: str) -> str:
    """NFC, then lower case letter by letter (no special final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.array([WORD if (k := unicodedata.category(c))[0] in "LN" else SPACE if c.isspace() else UNKNOWN if k == "Cn" else SYMBOL
                    for c in map(chr, range(0x110000))], np.uint8)
    out[0x1C:0x20] = CONTROL
    out[[ord("."), ord(",")]] = STOP
    return out


class Vocabulary:
    """Merges, ids and splitting of a tokenizer file with NFC, lower case and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a in self.ids and b in self.ids and a + b in self.ids:
                self.rank.setdefault((self.ids[a], self.ids[b]), (r, self.ids[a + b]))
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.chunks = Memo(self.encode_chunk, ROOM)
        self.decimal = Memo(str, ROOM)

    def parts(self, word: str) -> list[int]:
        s = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        s[-1] += self.suffix
        return [self.ids[x] for x in s if x in self.ids]

    def encode_word(self, word: str) -> tuple[int, ...]:
        p = self.parts(word)
        return tuple(p if len(p) < 2 else self.scan(p) if len(p) <= LONG else self.queue(p))

    def scan(self, p: list[int]) -> list[int]:
        """The contiguous rank array."""
        rank = self.rank
        near = [rank.get(x, (NONE, 0)) for x in zip(p, p[1:])]
        while near:
            best = min(near)
            if best[0] == NONE:
                break
            i = near.index(best)
            p[i] = best[1]
            del p[i + 1], near[i]
            if i < len(near):
                near[i] = rank.get((p[i], p[i + 1]), (NONE, 0))
            if i:
                near[i - 1] = rank.get((p[i - 1], p[i]), (NONE, 0))
        return p

    def queue(self, p: list[int]) -> list[int]:
        """The same merges for a long word: lowest rank first, leftmost of equals."""
        n, rank = len(p), self.rank
        nxt, prv, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(*rank[x], i, x) for i, x in enumerate(zip(p, p[1:])) if x in rank]
        heap = [(r, i, x, new) for r, new, i, x in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or (p[i], p[j]) != pair:
                continue
            p[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (x := (p[a], p[b])) in rank:
                    heapq.heappush(heap, (rank[x][0], a, x, rank[x][1]))
        return [x for x, ok in zip(p, alive) if ok]

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha():
            return self.encode_word(chunk)
        return tuple(chain.from_iterable(map(self.encode_word, self.pieces.findall(chunk))))

    def spaced(self, text: str) -> str | None:
        """A text without special tokens, folded, its chunks set apart by white space.

        A chunk holds one piece or several whole ones.  Stops and commas are set
        apart where no other symbol touches them, so that most chunks are plain
        words; other texts are cut by the pattern.  None if the text has control
        characters that str.split would take for white space, or unknown ones.
        """
        c = fold(text)
        k = classes()[np.frombuffer(c.encode("utf-32-le", "surrogatepass"), "<u4")]
        touch = (np.minimum(k[1:], k[:-1]) >= SYMBOL) & (np.maximum(k[1:], k[:-1]) == STOP)
        if ((k == CONTROL) | (k == UNKNOWN)).any():
            return None
        return " ".join(self.pieces.findall(c)) if touch.any() else c.replace(".", " . ").replace(",", " , ")

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def library_pieces(self, text: str) -> list[str]:
        """The pieces of a text with rare characters, as the library folds and cuts it."""
        byte = {s: i for i, s in enumerate(self.symbols)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(byte[c] for c in p).decode("utf-8") for p, _ in found]

    def encoded(self, text: str, chunk, word) -> Iterator:
        """``chunk`` of every chunk of a text without special tokens; of rare texts, ``word`` of every piece."""
        s = self.spaced(text)
        return map(word, self.library_pieces(text)) if s is None else map(chunk, s.split())

    def parts_of(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special, string) for the special tokens in a text and what lies between them."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield False, text[at:m.start()]
            yield True, m[0]
            at = m.end()
        yield False, text[at:]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; strings of special tokens in it become their ids."""
        out: list[int] = []
        for special, s in self.parts_of(text or ""):
            if special:
                out.append(self.special[s])
            else:
                out.extend(chain.from_iterable(self.encoded(s, self.chunks.__getitem__, self.encode_word)))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, special ones kept; ids outside the vocabulary are passed over."""
        known = self.tokens
        return " ".join([known[i] for i in ids if i in known])


def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker, and held with the words it has encoded."""
    return held(("bpe", path), lambda: Vocabulary(path))


def encode_documents(docs: DataFrame, vocab_path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids array<int>): token ids of every whole text.  Null text counts as empty."""
    kind = docs.schema[ident].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        for b in batches:
            for c in pieces(b):
                ids = pa.array([v.encode(t) for t in c.column("t").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([c.column("i"), ids], [ident, "ids"])

    return docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInArrow(work, f"`{ident}` {kind}, ids array<int>")


def encode_digests(docs: DataFrame, vocab_path: str, ident: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text in one pass.

    Returns (ident, n_tokens, ids_sha256, decoded_sha256) and, on request, ids.
    The decoded text is made from the ids alone.  Null and empty texts have no
    tokens and the digest of the empty string; every row returns, repeats too.
    """
    kind = docs.schema[ident].dataType.simpleString()
    names = [ident, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"`{ident}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab_path)
        dec = v.decimal.__getitem__
        for b in batches:
            for c in pieces(b):
                n, a, d, keep = [], [], [], []
                for t in c.column("t").to_pylist():
                    ids = v.encode(t)
                    n.append(len(ids))
                    a.append(sha256(" ".join(map(dec, ids)).encode()).hexdigest())
                    d.append(sha256(v.decode(ids).encode()).hexdigest())
                    if with_ids:
                        keep.append(pa.array(ids, pa.int32()))
                cols = [c.column("i"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
                if with_ids:
                    cols.append(lists(keep))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).mapInArrow(work, schema)


def lists(parts: list[pa.Array]) -> pa.ListArray:
    """One list array from the arrays of its rows."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], pa.int32()))


def pieces(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in smaller ones, so that a task's output of long texts stays small."""
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)
