"""Packing, spelling variants, digest trees and repeated spans against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemetra.llm import bpe, merkle, packing, paragraphs, passages, queries, spelling

PATH = queries.vocabulary_path()


def table(spark, rows):
    """Rows (doc_id, source, lang, n_chars, text), with columns whose names clash."""
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit("z") for c in ("word", "tree", "pos", "level", "bucket", "_doc", "_row", "x")}).repartition(3)


def prose(rnd, n, size=400):
    return [f"w{'abcdefgh'[rnd.randrange(8)]}{rnd.randrange(size)}" for _ in range(n)]


# --- packing -------------------------------------------------------------------

@pytest.mark.parametrize("pool", [500, 4_000_000])
def test_packing(spark, pool):
    rnd = random.Random(5)
    words = "the quick brown fox jumps over lazy dogs, unfathomably 42 é".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice((1, 5, 200, 900, 3000)))) for _ in range(60)] + [None, "", "   ", "x " * 9000]
    rows = [(i, None, None, None, t) for i, t in enumerate(texts)] + [(None, None, None, None, "null id")]
    got = packing.pack_documents(table(spark, rows), PATH, pool=pool, with_ids=True).toPandas()
    lib = Tokenizer.from_file(PATH)
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, _, _, _, t in rows}
    for name, g in got.groupby(got.doc_id.fillna(-1)):
        ids = want[None if name == -1 else int(name)]
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and (g.doc_tokens == len(ids)).all()
        assert [x for p in g["ids"] for x in p] == ids
        for r in g.itertuples():
            assert zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert got.doc_id.fillna(-1).nunique() == len(rows)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = g["length"].sum()
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and n <= 2048 and n & (n - 1) == 0
        assert (g["tier"] == n).all() and g["step_group"].nunique() == 1
    assert packing.pack_documents(table(spark, rows).limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(table(spark, rows), PATH, tiers=(300, 600))


def test_gaps_are_filled_whole_first():
    p = [packing.Piece(0, 0, 1500), packing.Piece(1, 0, 548), packing.Piece(2, 0, 700), packing.Piece(3, 0, 100)]
    full, still = packing.pack(p, [], (256, 512, 1024, 2048))
    assert [(x.doc, x.length) for x in full[0].pieces] == [(0, 1500), (1, 548)] and len(full) == 1
    assert [(x.doc, x.length) for x in still[0].pieces] == [(2, 700), (3, 100)]
    groups = packing.step_groups([packing.Window(0, [packing.Piece(i, 0, 256)]) for i in range(9)], step=1024)
    assert {g for _, g, _ in groups} == {0, 1, 2} and all(sum(x == g for _, x, _ in groups) <= 4 for g in range(3))


def test_every_code_point_as_the_library_has_it():
    lib, own = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}g " for c in points[k:k + 64]) for k in range(0, len(points), 64)]
    for k in range(0, len(texts), 2000):
        for t, e in zip(texts[k:k + 2000], lib.encode_batch(texts[k:k + 2000], add_special_tokens=False)):
            if own.encode(t) != e.ids:
                assert [c for c in t if own.encode(f"a{c}g") != lib.encode(f"a{c}g", add_special_tokens=False).ids] == []


# --- spelling ------------------------------------------------------------------

def slow_variants(rows, least_n=3):
    c = Counter()
    for i, _, _, _, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    v = {w: n for w, n in c.items() if len(w) >= 5 and n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = {}, {}
    for w in v:
        found = [x for x in v if near(w, x)]
        best = min(found, key=lambda x: (-v[x], x), default=None)
        if best and v[best] >= 2 * v[w]:
            form[w] = best
        out[w] = len(found)
    for w in v:
        x = w
        while x in form:
            x = form[x]
        out[w] = (form.get(w), x, v[w], out[w], v[form[w]] if w in form else None)
    return out


@pytest.mark.parametrize("full", [4096, 3])
def test_spelling_variants(spark, full):
    rnd = random.Random(7)
    stems = ["aaaaa", "aaaaaa", "aaaaaaa", "lettre", "letter", "letters", "lettér", "Ängste", "ângste", "abcdefghij", "abcdefghijk", "bbcdefghij", "àÿ×÷zzz"]
    rows = []
    for i in range(300):
        w = [rnd.choice(stems[:rnd.randrange(2, 14)]) for _ in range(30)]
        w = [x if rnd.random() < 0.7 else x[:k] + rnd.choice("abté") + x[k + rnd.randrange(2):] for x in w for k in [rnd.randrange(len(x))]]
        rows.append((i, None, None, None, " ".join(w)))
    rows += [(5, None, None, None, None), (None, None, None, None, "letter LETTER letter"), (6, None, None, None, ""), (7, None, None, None, "long" * 3000 + " 1")]
    rows += rows[:3]
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spelling.word_counts(table(spark, rows)), full=full).collect()}
    want = slow_variants(rows)
    assert got == want and sum(x[0] is not None for x in want.values()) > 20
    assert spelling.variants(spelling.word_counts(table(spark, rows).limit(0))).count() == 0


# --- digest tree ---------------------------------------------------------------

def digest(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def slow_tree(rows):
    def leaf(r, more=0):
        i, source, lang, n, text = r
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, None if n is None else n + more, text)])

    def levels(x):
        out = [x]
        while len(x) > 1:
            x = [digest(*x[i:i + 2]) for i in range(0, len(x), 2)]
            out.append(x)
        return out

    trees = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = [levels([leaf(r) for r in trees[k]]) for k in names]
    top = levels([b[-1][0] for b in built])
    out = []
    for k, name in enumerate(names):
        for p, r in enumerate(trees[name]):
            x, told = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0), []
            for tree, q in ((built[k], p), (top, k)):
                for level in tree[:-1]:
                    s = q ^ 1
                    if s < len(level):
                        told.append(level[s])
                    x = digest(x) if s >= len(level) else digest(level[s], x) if q & 1 else digest(x, level[s])
                    q >>= 1
            out.append((r[0], leaf(r), built[k][-1][0], top[-1][0], digest(*told), x, x == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"en": 700, "de": 257, None: 3, "": 1, "é": 2}, {"en": 1}, {"en": 5}])
def test_merkle(spark, sizes, tmp_path):
    rows = [(i * 3 if i % 11 else i // 2, "s", lang, None if i % 5 == 0 else i, None if i % 7 == 0 else f"text {i}")
            for lang, n in sizes.items() for i in range(n)]
    rows += [(None, None, "en", None, None)] * 2 + [(4, "s", "en", 4, "")] * 2
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == slow_tree(rows)


def test_merkle_of_no_rows(spark, tmp_path):
    table(spark, [(1, None, None, None, None)]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_merkle_manifest(spark, str(tmp_path)).count() == 0


# --- repeated spans ------------------------------------------------------------

def lay(rnd, words):
    return "".join(w + rnd.choice((" ", " ", " ", "\n", ", ")) for w in words)


def test_passages_across_and_inside_lines(spark):
    rnd = random.Random(3)
    texts, planted = [], []
    for _ in range(60):
        p = prose(rnd, rnd.randrange(50, 75), 9999)
        for _ in range(2):
            texts.append(lay(rnd, prose(rnd, 60, 9999) + p + prose(rnd, 60, 9999)))
        planted.append((len(texts) - 2, len(texts) - 1, p))
    clean = len(texts)
    texts += [lay(rnd, prose(rnd, 200, 9999)) for _ in range(60)] + [None, "", "one two"]
    df = table(spark, [(i, None, None, None, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in passages.repeated_spans(df).collect()}
    caught = 0
    for a, b, p in planted:
        r = got.get(b)
        if r is None:
            continue
        assert r["kept_id"] == a
        mine, first = (re.findall(r"\w+", texts[i]) for i in (b, a))
        span = mine[r["start"]:r["start"] + r["n_words"]]
        assert span == first[r["kept_start"]:r["kept_start"] + r["n_words"]] and set(span) & set(p)
        caught += len(span) >= 0.6 * len(p)
    assert caught >= 54 and all(i < clean for i in got)
    out = {r["doc_id"]: r for r in paragraphs.without_repeats(df).collect()}
    assert all(out[i]["text"] == texts[i] and out[i]["_doc"] == "z" for i in range(len(texts)) if i not in got)
    assert all(len(out[i]["text"]) < len(texts[i]) for i in got)
    assert passages.repeated_spans(df.limit(0)).count() == 0


def test_cut_text():
    t = "a b c\nd e f g\nh i"
    assert passages.cut_text(t, [], [(1, 3)]) == "a  e f g\nh i"
    assert passages.cut_text(t, [1], []) == "a b c\nh i"
    assert passages.cut_text(t, [2], [(0, 1)]) == " b c\nd e f g"
    assert passages.cut_text(t, [0, 1, 2], []) == ""
