"""The near-dedup stage: SimHash groups first, bands for the rest, exact Jaccard for all."""

import random
import weakref

import numpy as np
import pytest

import corpus_pipeline
from telemetra.llm import bpe, paragraphs, simhash
from telemetra.llm.queries import vocabulary_path
from test_dedup import docs_of, groups, prose


def near_copies(seed):
    """Texts, copies with one word changed, and copies alike by a little more than 0.8."""
    rnd = random.Random(seed)
    texts = [prose(rnd, n) for n in (30, 80, 200, 300, 400)]
    for t in texts[2:5]:
        for edits in (1, 1, 2, 6):
            w = t.split()
            for at in rnd.sample(range(5, len(w) - 5), edits):
                w[at] = "changed" + str(rnd.randrange(10 ** 6))
            texts.append(" ".join(w))
    return texts


def shingles(text, k=5):
    w = (text or "").lower().split() or [""]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def test_near_dedup_groups_by_simhash_first(spark, monkeypatch):
    """Copies of one changed word come together by their SimHashes; the bands get only what these leave apart."""
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, distance: asked.append(distance) or links(fps, distance))
    texts = near_copies(3) + [None, "", "one two"]
    docs = docs_of(spark, texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    sets = [shingles(t) for t in texts]
    ids = range(len(texts))
    want = groups([(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], ids)
    assert kept == {i for i in ids if want[i] == i}
    assert asked == [5]


def test_fingerprint_groups(spark):
    texts = near_copies(4)
    h = paragraphs.Hasher(5, 1, 1)
    held = [h.hashes(t.split()) for t in texts]
    flat, starts = h.shingles_of_all(held)
    got = [int(x) for x in simhash.majorities(flat, starts, chunk=300)]
    for i, x in enumerate(got):
        part = flat[starts[i]:starts[i + 1] if i + 1 < len(starts) else None].tolist()
        assert x == sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in part) > len(part))
    ids = range(len(texts))
    want = groups([(a, b) for a in ids for b in ids if a < b and (got[a] ^ got[b]).bit_count() <= 5], ids)
    signed = np.array(got, np.uint64).view(np.int64).tolist()
    found = {}
    for r in paragraphs.fingerprint_groups(spark.createDataFrame(list(enumerate(signed)), "id long, fp long"), 5).collect():
        found.setdefault(r["cell"], set()).add(r["id"])
    by = {}
    for i, r in want.items():
        by.setdefault(r, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in by.values() if len(x) > 1)
    assert len(found) == 3 and sum(map(len, found.values())) >= 9


@pytest.mark.parametrize("seed", range(6))
def test_forest_of_arrays_links_what_sets_do(seed):
    rnd = random.Random(seed)
    base = [rnd.sample(range(1, 10 ** 6), rnd.randint(1, 40)) for _ in range(6)]
    sets = [set(b) - set(rnd.sample(b, len(b) // 9)) | {rnd.randrange(10 ** 6) for _ in range(len(b) // 12)} for b in base for _ in range(9)] + [set()]
    flat = np.array([x for s in sets for x in sorted(s)], np.int64)
    got = paragraphs._forest(flat, np.array([len(s) for s in sets]), 0.8)
    ids = range(len(sets))
    alike = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(min(x), max(x)) for x in got} <= alike and groups(got, ids) == groups(alike, ids)


class Steps:
    """Stands for a table and catches the function that a step gives to its Python workers."""

    def select(self, *cols):
        return self

    def mapInArrow(self, work, kind):
        self.work = work
        return self


def test_a_worker_lets_the_words_of_bpe_go(spark):
    """The workers of the pipeline live through all stages: what BPE keeps in them must not add to near-dedup's memory."""
    path = vocabulary_path()
    gone = weakref.ref(bpe.vocabulary(path))
    assert bpe.vocabulary(path) is gone()
    bpe.vocabulary(path).encode("some words to keep")
    near = Steps()
    paragraphs._shingle_table(near, "doc_id", "text", 1, 5)
    assert not list(near.work(iter([]))) and gone() is None
    assert bpe.vocabulary(path).encode("some words to keep")
