"""Stages of the pipeline on made-up rows, against brute force."""

import random

import corpus_pipeline
from test_dedup import groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def fresh(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_near_dedup_is_exact_jaccard(spark):
    rnd = random.Random(4)
    texts = []
    for _ in range(40):
        w = fresh(rnd, rnd.randrange(60, 400))
        texts.append(" ".join(w))
        for edits in (1, 1, 2, 3, 8):
            c = list(w)
            for at in rnd.sample(range(len(c)), edits):
                c[at] = "edit"
            texts.append(" ".join(c))
    texts += ["a b c d", "a b c e", "", " ", None]
    sets = [shingles(t) for t in texts]
    root = groups([(a, b) for b in range(len(texts)) for a in range(b) if alike(sets[a], sets[b])], range(len(texts)))
    want = {i for i in root if root[i] == i}
    got = corpus_pipeline.near_dedup(spark, rows_of(spark, enumerate(texts)), "")
    assert {r["doc_id"] for r in got.collect()} == want
    assert 40 < len(want) < len(texts) - 60


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    """Rows of a null or repeated id are decided one by one; only rows equal in id and text are one."""
    rnd = random.Random(9)
    item = " ".join(fresh(rnd, 30))
    a, b, c, d, e = (" ".join(fresh(rnd, 60)) for _ in range(5))
    line = " ".join(fresh(rnd, 50))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def texts(stage, rows):
        got = stage(spark, rows_of(spark, rows), str(tmp_path))
        assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        return sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect())

    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, e)]
    assert texts(corpus_pipeline.near_dedup, rows) == sorted([(-1, a), (-1, b), (7, c), (7, d), (8, e)])
    rows = [(None, a), (None, f"{b} {item}"), (7, c), (7, f"{item} {d}"), (8, e)]
    assert texts(corpus_pipeline.decontamination, rows) == sorted([(-1, a), (7, c), (8, e)])
    half = " ".join(item.split()[:15]), " ".join(item.split()[11:])       # together, but not each, the item
    assert texts(corpus_pipeline.decontamination, [(None, half[0]), (None, half[1])]) == sorted((-1, x) for x in half)
    rows = [(None, f"{line}\n{a}"), (None, f"{b}\n{c}"), (7, f"{line}\n{d}"), (7, f"{e}\nend")]
    assert texts(corpus_pipeline.substring_dedup, rows) == sorted([(-1, f"{line}\n{a}"), (-1, f"{b}\n{c}"), (7, d), (7, f"{e}\nend")])
    rows = [(1, a), (None, b), (None, "123"), (None, None), (7, c), (7, "...")]
    assert texts(corpus_pipeline.language_id, [*rows, *[(i, d) for i in range(20, 40)]])[:2] == sorted([(-1, b), (1, a)])
