"""Near-duplicate operators against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from telemetra.llm import components, decontaminate, paragraphs, simhash
from telemetra.llm.common import split_cells

SCHEMA = "doc_id long, text string, u string, fp string, cell string"


def docs_of(spark, texts):
    """Documents with columns whose names an operator uses itself."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text, k=4):
    w = [x.decode() for x in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def prose(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma Delta eps zeta eta theta iota kappa la mu nu xi".split()) + rnd.choice(["", "", "é", "x"]) for _ in range(n))


def test_components(spark):
    rnd = random.Random(3)
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(7, i) for i in range(300, 500)]
    some = [(rnd.randrange(100), rnd.randrange(100)) for _ in range(60)]
    links = chain + star + some
    want = groups(links, {x for e in links for x in e})
    df = spark.createDataFrame(links + [(None, 3), (5, None)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    single = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in single}
    assert components.connected_components(df.limit(0)).count() == 0


def test_split_cells_lets_all_members_meet(spark):
    rows = [(1, i) for i in range(57)] + [(2, 100), (3, 7), (3, 8)]
    df = split_cells(spark.createDataFrame(rows, "cell long, x long"), "cell", "x", block=10)
    tasks = {}
    for r in df.collect():
        tasks.setdefault((r["cell"], r["_lo"], r["_hi"]), set()).add(r["x"])
    met = {(a, b) for k, s in tasks.items() if k[0] == 1 for a in s for b in s}
    assert len(met) == 57 * 57 and max(map(len, tasks.values())) < 57
    assert {k[0] for k in tasks} == {1, 3}


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5, 8, 9])
def test_grid_join_loses_no_link(spark, distance):
    rnd = random.Random(distance)
    base = [rnd.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, distance + 2))))
    fps = sorted(fps)
    want = groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance], fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance).collect()
    to = dict(zip(signed, fps))
    assert all((to[r["u"]] ^ to[r["v"]]).bit_count() <= distance for r in links)
    assert groups([(to[r["u"]], to[r["v"]]) for r in links], fps) == want


def test_simhash_documents(spark):
    rnd = random.Random(5)
    texts = [prose(rnd, n) for n in (1, 2, 3, 4, 5, 60, 300, 3000)]
    texts += [None, "", " \n\t", "A b\x0bC d", "a B c D", "é É é", texts[6], texts[6] + " end", "word " * 40_000]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fp = [slow_fingerprint(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fp
    ids = range(len(texts))
    want = groups([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert {i: got[i]["component"] for i in ids} == want


def test_simhash_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (9, "c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def slow_repeats(texts, least, k=5, t=0.8):
    occ = [(d, n, re.findall(r"\w+", line.lower())) for d, x in enumerate(texts) for n, line in enumerate((x or "").split("\n"))]
    occ = [(d, n, w) for d, n, w in occ if len(w) >= least]
    sets = [{tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for _, _, w in occ]
    links = [(a, b) for a in range(len(occ)) for b in range(a) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])]
    root = groups(links, range(len(occ)))
    size = {}
    for r in root.values():
        size[r] = size.get(r, 0) + 1
    return {(occ[i][:2]): (occ[r][:2]) for i, r in root.items() if size[r] > 1}


def test_repeated_paragraphs(spark):
    rnd = random.Random(8)
    shared = [prose(rnd, n) for n in (45, 60, 90)]
    edited = shared[2].split()
    edited[30] = "other"
    texts = [prose(rnd, 50) + "\n" + shared[rnd.randrange(3)] for _ in range(12)]
    texts += ["head\n" + " ".join(edited), None, "", "short line", shared[0] + "\n\n" + shared[0].upper() + "!", "\n".join([shared[1]] * 3),
              prose(rnd, 30_000), shared[2] + " " + prose(rnd, 3)]
    df = docs_of(spark, texts)
    got = paragraphs.repeated_paragraphs(df).collect()
    want = slow_repeats(texts, 40)
    assert {(r["doc_id"], r["para"]): (r["kept_id"], r["kept_para"]) for r in got} == want
    assert all(r["removed"] == ((r["doc_id"], r["para"]) != (r["kept_id"], r["kept_para"])) for r in got)
    out = {r["doc_id"]: r for r in paragraphs.without_repeats(df).collect()}
    for i, t in enumerate(texts):
        lines = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((i, n), (i, n)) == (i, n))
        assert out[i]["text"] == lines and out[i]["cell"] == "z"
    assert paragraphs.repeated_paragraphs(df.limit(0)).count() == 0


def test_band_tuning():
    for t, recall in ((0.8, 0.9999), (0.5, 0.9), (0.9, 0.99), (1.0, 0.9)):
        b, r = paragraphs.tune_bands(t, recall)
        assert b * r <= 128 and 1 - (1 - t ** r) ** b >= recall - 1e-12


def test_band_recall():
    rnd = np.random.default_rng(1)
    h = paragraphs.Hasher(5, *paragraphs.tune_bands())
    hit = 0
    for _ in range(200):
        x = rnd.integers(0, 1 << 63, 190, dtype=np.uint64)
        k = h.signatures(x[[*range(170), *range(19, len(x))]], np.array([0, 170]))   # 151 of 190 shared
        hit += bool(set(k[0].tolist()) & set(k[1].tolist()))
    assert hit >= 198


def slow_contained(docs, items, k=5, t=0.8):
    def shingles(x):
        w = [y for y in re.split(r"[\W_]+", (x or "").lower()) if y]
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for d, x in docs:
        for i, y in items:
            if s := shingles(y):
                n = len(s & shingles(x))
                if n >= t * len(s):
                    out[d, i] = (n, len(s))
    return out


def test_decontamination(spark):
    rnd = random.Random(4)
    items = [(i, prose(rnd, rnd.randint(5, 60))) for i in range(30)] + [(30, "too short"), (31, None), (32, "same words here again now " * 3)]
    docs = []
    for d in range(80):
        x = prose(rnd, rnd.randint(0, 400)).split()
        if d % 2:
            y = (items[d % 30][1] or "").split()
            for _ in range(d % 5):
                y[rnd.randrange(len(y))] = "changed"
            at = rnd.randint(0, len(x))
            x[at:at] = [w.upper() + "," for w in y]
        docs.append((d, " ".join(x)))
    docs += [(80, None), (81, ""), (82, items[3][1] + " " + prose(rnd, 20_000)), (82, "again"), (83, "same words here again now same words here again now")]
    df = spark.createDataFrame([(d, x, "e") for d, x in docs], "doc_id long, text string, item string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in decontaminate.contaminated(df, it).collect()}
    assert got == slow_contained(docs, items)
    bad = {d for d, _ in got}
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, it).collect()) == sorted(d for d, _ in docs if d not in bad)
    assert decontaminate.contaminated(df, it.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), it).count() == 0
    nulls = df.union(spark.createDataFrame([(None, items[0][1], "e")], df.schema))
    assert decontaminate.contaminated(nulls, it).filter(F.col("doc_id").isNull()).count() == 1
