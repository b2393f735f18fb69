"""Tokens, languages, licences, pages, vectors and chats."""

import random
import re
import struct
import unicodedata
import zlib
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from telemetra.llm import bpe, chat, html_text, langid, licences, queries, token_files, topk

PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def lib():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(PATH)


def odd_texts(n=250):
    rnd = random.Random(1)
    chars = "aAbB zZéÉ Σς İ1２Ⅷ'’s'll.,..<>|\x1c\u0085  ​éṩ가ß😀漢字!?…\n\tᄀ퟿"
    out = ["", " ", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "can't we'll I'D", "x" * 3000, "!" * 500, "ab.cd,ef", "a...b", ".,.", "a ,b. c"]
    return out + ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "<|endoftext|>", "ab" * 120]) for _ in range(n)]


def test_bpe_equals_the_library(lib):
    v, p = bpe.Vocabulary(PATH), token_files.Packed(PATH)
    texts = odd_texts()
    packed = p.encode_batch(texts)
    for t, b in zip(texts, packed):
        e = lib.encode(t, add_special_tokens=False)
        assert v.encode(t) == e.ids, t
        assert np.frombuffer(p.encode(t), "<u4").tolist() == e.ids == np.frombuffer(b, "<u4").tolist(), t
        assert v.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_scan_and_queue_agree():
    v, rnd = bpe.Vocabulary(PATH), random.Random(2)
    for _ in range(200):
        w = "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 150)))
        assert v.scan(v.parts(w)) == v.queue(v.parts(w))


def test_bounded_memory():
    v = bpe.Vocabulary(PATH)
    v.chunks.room = 2
    assert v.encode("one two three four one") and len(v.chunks) == 2


def test_encode_digests(spark, lib):
    rows = [(i, t) for i, t in enumerate(odd_texts(40))] + [(None, "null id"), (7, None), (7, None), (8, "long " * 60_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe.encode_digests(df, PATH, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def test_token_files(spark, lib, tmp_path):
    rows = [(i * 3 % 101, t) for i, t in enumerate(odd_texts(60))] + [(200, None), (None, "no id"), (5, "again"), (201, "far " * 70_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, shard string")
    path, index = token_files.write_token_files(df, PATH, str(tmp_path / "t"))
    got = sorted(map(lambda r: r.asDict(), index.collect()), key=lambda r: r["start"])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    start = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, sorted(rows, key=key)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        if i != 5:      # equal ids keep some order
            assert (r["doc_id"], r["n_tokens"], r["ids_crc32"]) == (i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            data = (tmp_path / "t" / "shards" / r["shard"]).read_bytes()
            assert token_files.read_record(data, r["offset"], r["length"]) == (i, ids)
        assert r["start"] == start
        start += r["n_tokens"]
    _, none = token_files.write_token_files(df.limit(0), PATH, str(tmp_path / "n"))
    assert none.count() == 0


def test_broken_records_are_found():
    ids = struct.pack("<3I", 5, 6, 7)
    data = bytearray(token_files.frame(1, ids) + token_files.frame(None, b"") + token_files.frame(2, ids, 2))
    assert [(d, i.tobytes()) for _, _, d, i in token_files.frames(bytes(data))] == [(1, ids), (None, b""), (2, ids)]
    for at in (2, 9, 15, 30):
        bad = data.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(token_files.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_files.frames(bytes(data[:30])))


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    assert [token_files.records_per_file(n) for n in (0, 100, 1_000_000, 1 << 31)] == [20_000, 20_000, 89, 1]
    monkeypatch.setattr(token_files, "FILE_BYTES", 40_000)
    df = spark.createDataFrame([(i, f"w{i} " * (10 + 390 * (i % 3 == 0))) for i in range(60)], "doc_id long, text string")
    path, index = token_files.write_token_files(df, PATH, str(tmp_path / "b"))
    assert max(f.stat().st_size for f in (tmp_path / "b" / "shards").glob("part-*")) <= 40_000
    got = index.orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(60)) and len({r["shard"] for r in got}) > 8
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_language_model_by_brute_force(spark):
    """Every language has its own share of the sample; repeated texts count once; weights follow from plain counts."""
    rnd = random.Random(4)
    words = {"en": "the and cat dog house", "de": "der und hund katze haus", "fr": "le et chat chien maison", "ca": "els i gos gat casa"}
    rows = [(" ".join(rnd.choices(words[x].split(), k=6)) + f" {i}", x) for x, n in (("en", 900), ("de", 300), ("fr", 40)) for i in range(n)]
    rows += [("els gats i els gossos", "ca")] * 400                # a language of one text
    df = spark.createDataFrame([*rows, (None, "xx"), ("a", None)], "text string, lang string")
    m = langid.fit(df, train_rows=60)
    assert m.langs == ["ca", "de", "en", "fr"]                     # none is lost to the sample
    assert langid.fit(df, train_rows=60).weights.tobytes() == langid.fit(df.repartition(7), train_rows=60).weights.tobytes()

    m = langid.fit(df)
    dist = np.full((4, langid.BUCKETS), 0.0)
    for t, x in set(rows):
        data = f" {t.lower()} ".encode()
        at = [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 % (1 << 32)) >> 17 for i in range(len(data) - 2)]
        for g in at:
            dist[m.langs.index(x), g] += 1 / len(at)
    dist = dist / dist.sum(axis=1, keepdims=True) + 1e-7
    for j in range(m.code.shape[1]):
        up = m.code[:, j] > 0
        assert np.allclose(m.weights[:, j], np.log(dist[up].mean(axis=0) / dist[~up].mean(axis=0)), atol=1e-3)
    for t, x in rows[::97]:
        margin = m.weights[langid.grams(t)].mean(axis=0) * langid.SCALE
        loss = [sum(np.logaddexp(0, -c * v) for c, v in zip(m.code[i], margin)) for i in range(4)]
        assert m.predict(t)[0] == m.langs[int(np.argmin(loss))] == x


def test_language_id_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op8_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark):
    rows = [(i, x, la) for i, (x, la) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 5)]
    rows += [(90, None, "en"), (91, "", None), (92, "123 !?", "de"), (93, "der und die " * 200_000, None), (None, "the and the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.learn_from_documents(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, m).collect()}
    assert got[90] == got[91] == got[92] == ("und", 0.0) and got[93][0] == "de" and got[None][0] == "en"
    assert langid.predict(df, langid.fit(df.limit(0))).filter("lang_pred <> 'und'").count() == 0
    one = langid.fit(df.filter("lang = 'en'"))
    assert langid.predict(df, one).filter("doc_id = 93").first()["lang_pred"] == "en"
    assert langid.predict(df.limit(0), m).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 7, 8, 40):
        m = langid.codewords(n)
        assert len(np.unique(m, axis=0)) == n and (np.abs(m.sum(axis=0)) < n).all()
    assert min((a != b).sum() for i, a in enumerate(langid.codewords(4)) for b in langid.codewords(4)[:i]) == 4


APACHE = next(t for x, part, t in licences.TEMPLATES if (x, part) == ("Apache-2.0", "notice"))


def test_related_licences_are_told_apart(spark):
    """Every template is found as itself, so no licence is taken for a related one."""
    df = spark.createDataFrame([(i, t.lower()) for i, (_, _, t) in enumerate(licences.TEMPLATES)], "doc_id int, text string")
    got = {r["doc_id"]: (r["licence"], r["part"], r["dice"]) for r in licences.licence_scan(df, licences.template_table(spark)).collect()}
    assert got == {i: (x, part, 1.0) for i, (x, part, _) in enumerate(licences.TEMPLATES)}


def test_licences(spark):
    lines = "Some prose.\nReleased under the MIT license!\n" + APACHE.upper() + "\nreleased under a permissive thing"
    df = spark.createDataFrame([(1, lines, "a"), (2, None, "a"), (3, "", "a"), (4, "All rights reserved.", "a"), (4, "All rights reserved.", "b"),
                                (5, "x y " * 50_000, "a"), (None, "Licensed under CC BY-NC 4.0.", "a")], "doc_id long, text string, part string")
    got = {(r["doc_id"], r["line"]): (r["licence"], r["part"], r["dice"]) for r in licences.licence_scan(df, licences.template_table(spark)).collect()}
    assert got == {(1, 1): ("MIT", "statement", 1.0), (1, 2): ("Apache-2.0", "notice", 1.0), (4, 0): ("proprietary", "statement", 1.0),
                   (None, 0): ("CC-BY-NC-4.0", "statement", 1.0), (1, -1): ("Apache-2.0", "notice", 0.868421)}
    none = licences.template_table(spark).limit(0)
    assert licences.licence_scan(df, none).count() == 0
    assert licences.licence_scan(df.limit(0), licences.template_table(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy <div>now</div></div><header>site</header>
<article><h1>Head &amp; line</h1><p><b>One
 two<br>three<p>A&lt;b &copy; &am</p><form><input>mail</form><aside>side</aside><section id="comments"><p>reader</p></section>
<ul><li>x</li><li>y</li></ul><p hidden>gone</p></article><footer>foot</footer></body>"""


def test_html_blocks(spark):
    rows = [(1, "http://a.com/x", PAGE), (2, None, None), (3, "odd", ""), (4, "http://b.com/p/1", "<p>Top line</p><p>own one</p><p>Bottom</p>"),
            (5, "http://b.com/p/2", "<p>Top line</p><p>own two<p>Bottom"), (6, "http://c.com/", "<p>alone</p>"),
            (7, "http://d.com/1", "<p>copy</p>"), (7, "http://d.com/1", "<p>copy</p>"), (8, "http://e.com", "plain &gt; text " + "w " * 100_000)]
    df = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[1] == "Head & line\nOne two three\nA<b © &am\nx\ny"
    assert got[2] == got[3] == ""
    assert {got[4], got[5]} <= {"own one", "own two", "Top line\nown one\nBottom", "Top line\nown two\nBottom"}
    assert got[6] == "alone" and got[7] == "copy" and got[8].startswith("plain > text w w")
    assert df.count() == html_text.main_text(df).count() and html_text.main_text(df.limit(0)).count() == 0


def test_differencing_deletes_shared_lines():
    a = ("h", "/p/1", html_text.blocks("<p>Top<p>own one<p>Bottom"))
    b = ("h", "/p/2", html_text.blocks("<p>Top<p>own two<p>Bottom"))
    c = ("h", "/q", html_text.blocks("<p>own one"))
    assert html_text._text(a, c, b) == "own one" and html_text._text(b, a, None) == "own two"
    assert html_text._text(a, a, None) == "Top\nown one\nBottom"


def test_common_is_a_longest_subsequence():
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        got = html_text.common(a, b)
        at = iter(b)
        assert len(got) == best[-1, -1] and all(a[i] in at for i in sorted(got))


def test_top_k_brute_force(spark):
    rnd = np.random.default_rng(3)
    v = {i: np.floor(64.0 * rnd.normal(0, 0.2, 16)) / 64 for i in range(400)}
    v |= {1000: v[20].copy(), 1001: v[20].copy(), 1002: np.full(16, 1e6)}
    rows = [(i, x.tolist(), 1) for i, x in v.items()] + [(2000, None, 1), (2020, [None, *[0.1] * 15], 1), (2040, [float("nan")] * 16, 1), (2060, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int")
    want = []
    for q in (i for i in v if i % 20 == 0):
        s = sorted((-int(np.floor(64 * v[q]) @ np.floor(64 * v[c])), c) for c in v if c != q)[:20]
        want += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    got = topk.top_k(topk.quantised(df), F.col("id") % 20 == 0, 20, stripe=64)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = df.filter("vec_id < 10")
    assert topk.top_k(topk.quantised(few), F.col("id") % 20 == 0, 20).count() == 9
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("id") % 20 == 0).count() == 0


def test_number_types():
    one = np.array([[1]])
    assert [topk.exact_kind(one * q, one) for q in (3, 1 << 30, 1 << 60)] == [np.float32, np.float64, np.int64]


EVENTS = [  # conversation, message, sequence, kind, role, text
    (1, 1, 1, "message", "user", "hi <b> & [x] </s>"), (1, 2, 2, "delta", "assistant", "he"), (1, 2, 3, "delta", "assistant", "llo"),
    (1, 2, 4, "regenerate", "assistant", "He"), (1, 2, 5, "delta", "assistant", "y<|end|>&lt;"), (1, 1, 6, "edit", "user", "hi there"),
    (2, 1, 1, None, None, None), (2, 2, 2, "message", "assistant", "a\nb 😀"), (None, 1, 1, "message", "user", "lost")]


def test_chat_events_fold_and_read_back(spark):
    df = spark.createDataFrame([(*e, "x") for e in EVENTS], "conv long, msg long, seq long, kind string, role string, text string, formatted string")
    rec = chat.format_chats(df, "conv", ["msg"])
    turns = {r["conv"]: [tuple(t) for t in r["t"]] for r in rec.select("conv", chat.read_back(rec).alias("t")).collect()}
    assert turns == {1: [("user", "hi there", None), ("assistant", "Hey<|end|>&lt;", "Hey<|end|>&lt;")],
                     2: [("", "", None), ("assistant", "a\nb 😀", "a\nb 😀")], None: [("user", "lost", None)]}
    d = {r["conv"]: r for r in chat.digest(rec, "conv").collect()}
    assert d[2]["turns_sha256"] == sha256("\n\nassistant\na\nb 😀\n".encode()).hexdigest()
    assert (d[2]["loss_chars"], d[2]["n_turns"], d[1]["loss_sha256"]) == (5, 2, sha256(b"Hey<|end|>&lt;").hexdigest())
    text = {r["conv"]: r["formatted"] for r in rec.collect()}
    assert text[1].count(chat.END) == 2 and d[1]["formatted_chars"] == len(text[1])
    assert chat.format_chats(df.limit(0), "conv", ["msg"]).count() == 0


def test_escape_is_reversible(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["&", "<", "[", "amp;", "lt;", "lsqb;", "|end|>", "é", "\n", "]"]) for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    r = df.select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("b")).collect()
    assert all(x["t"] == x["b"] and "<" not in x["e"] and "[" not in x["e"] for x in r)


def test_fold_is_nfc_and_plain_lower():
    assert bpe.fold("ΑΣ é") == unicodedata.normalize("NFC", "ασ é")


def test_every_page_is_differenced_with_its_nearest_differing_page(spark, monkeypatch):
    """Neighbours by a loop over the sorted pages of a host; runs of copies and the number of partitions change nothing."""
    rnd = random.Random(8)
    frame = ["Home", "Imprint", "All rights"]
    rows = []
    for i in range(90):
        body = [f"own {i} {k}" for k in range(rnd.randrange(1, 5))] if i % 9 else ["copied"]
        lines = [frame[0], *body, *(frame[1:] if i % 4 else frame[1:2])]
        mark = "<article><p>kept</article>" if i % 10 == 3 else ""
        rows.append((i, f"http://h{i % 3}.de/{'abc'[i % 2]}/{i // 9 if i % 5 else 0}", "".join(f"<p>{x}</p>" for x in lines) + mark))
    rows += [(200 + i, "http://h1.de/b/copy", "<p>Home<p>same<p>Imprint") for i in range(20)]
    rows += [(300, None, "<p>Home"), (301, "http://h0.de/x", None), (302, "http://alone.de/", "<p>Home")]
    page = {i: (re.sub(r"^http://", "", u or "").split("/", 1)[0], "/" + (u or "").split("/", 3)[3] if u else "", html_text.blocks(h)) for i, u, h in rows}

    def digest(i):
        return xxhash.xxh128_digest(b"".join(xxhash.xxh64_digest(s.encode()) for _, s in page[i][2]))

    order = sorted(page, key=lambda i: (page[i][0], page[i][1], digest(i)))

    def beside(i, steps):
        for j in steps:
            if page[j][0] != page[i][0]:
                return None
            if digest(j) != digest(i):
                return page[j]
        return None

    want = {}
    for at, i in enumerate(order):
        want[i] = html_text._text(page[i], beside(i, order[:at][::-1]), beside(i, order[at + 1:]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r["page_id"]: r["text"] for r in html_text.main_text(df.repartition(n)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(want[200 + i] == "same" for i in range(20)) and "Home" not in want[200]

    # differencing runs for pages that markup decides, too
    seen, plain = [], html_text.common
    monkeypatch.setattr(html_text, "common", lambda a, b: seen.append(1) or plain(a, b))
    a = ("h", "/1", html_text.blocks("<nav>Top</nav><article><p>text</article>"))
    assert html_text._text(a, ("h", "/2", html_text.blocks("<nav>Top</nav><article><p>text<p>more</article>")), None) == "text" and seen
