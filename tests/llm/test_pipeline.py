"""The pipeline's stages against brute force on the smallest tables."""

import re

import duckdb

import corpus_pipeline
from telemetra.llm import bpe, langid, queries
from test_dedup import groups, slow_contained


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [f(spark, docs, sf) for _, f in corpus_pipeline.STAGES[:1]][0]
    model = langid.learn_from_documents(docs)
    rows = {r["doc_id"]: r for r in docs.collect()}
    told = {i: r["text"] for i, r in rows.items() if (p := model.predict(r["text"]))[0] != "und" and not p[2]}
    assert {r["doc_id"] for r in kept.collect()} == set(told)
    assert kept.columns == docs.columns

    def shingles(t):
        w = t.lower().split() or [""]
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {i: shingles(t) for i, t in told.items()}
    root = groups([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9], sets)
    lone = {i: told[i] for i in told if root[i] == i}
    near = corpus_pipeline.near_dedup(spark, kept, sf)
    assert {r["doc_id"] for r in near.collect()} == set(lone) and near.columns == docs.columns

    sub = corpus_pipeline.substring_dedup(spark, near, sf)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in sub.collect()}
    assert set(got) == set(lone) and all(n == len(t) for t, n in got.values()) and sub.columns == docs.columns
    cut = {i: t for i, (t, _) in got.items()}
    words = {i: re.findall(r"\w+", t) for i, t in lone.items()}

    def runs(w, n):
        return {tuple(x.lower() for x in w[k:k + n]) for k in range(len(w) - n + 1)}

    # of 60 words in a row that an earlier document holds, next to none stay; what has no 12 in common stays whole
    earlier, met, stay = set(), 0, 0
    short = {}
    for i in sorted(lone):
        for x in runs(words[i], 12):
            short.setdefault(x, set()).add(i)
    for i in sorted(lone):
        before = runs(words[i], 60) & earlier
        met += len(before)
        stay += len(before & runs(re.findall(r"\w+", cut[i]), 60))
        earlier |= runs(words[i], 60)
        alone = all(len(short[x]) == 1 for x in runs(words[i], 12)) and len(runs(words[i], 12)) == max(0, len(words[i]) - 11)
        assert cut[i] == lone[i] or not alone
        rest = iter(lone[i])
        assert all(c in rest for c in cut[i])           # nothing is added or moved
    assert met > 0 and stay <= 0.03 * met

    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    bad = {d for d, _ in slow_contained(cut.items(), items)}
    clean = corpus_pipeline.decontamination(spark, sub, sf)
    assert {r["doc_id"] for r in clean.collect()} == set(cut) - bad and clean.columns == docs.columns

    v = bpe.Vocabulary(queries.vocabulary_path())
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert out == {i: v.encode(cut[i]) for i in cut if i not in bad}


def test_stages_take_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, sf).count() == 0


def test_stages_keep_columns_whose_names_clash(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").withColumns(
        {c: F.lit(c) for c in ("_doc", "_bad", "_gone", "_row", "_lines", "_spans", "cell", "key")})
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.filter("_row <> '_row' or _doc <> '_doc' or _bad <> '_bad'").count() == 0 and out.count() > 0
