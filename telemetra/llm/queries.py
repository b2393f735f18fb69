"""The text operators applied to the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import bpe, chat, decontaminate, html_text, langid, licences, merkle, packing, paragraphs, simhash, spelling, token_files, topk
from telemetra.llm.common import table

#: Folder of the public tokenizers' module; read where the vocabulary's path is wanted.
TOKENIZERS = "/opt/tokenizers"


def vocabulary_path(name: str = "word_bpe_49k.json", folder: str = TOKENIZERS) -> str:
    try:
        import public_tokenizers as P
    except ImportError:
        return f"{folder}/{name}"
    return P.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that occurs again in the documents: lines of 40 words or more, exactly or nearly, and spans of words."""
    return (paragraphs.repeated_passages(table(spark, sf_dir, "documents"))
            .withColumnRenamed("kept_id", "kept_doc_id"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence passages of all documents."""
    return licences.licence_scan(table(spark, sf_dir, "documents"), licences.template_table(spark))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token records; the index made from the files."""
    _, index = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0, 20)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    got = langid.predict(docs, langid.learn_from_documents(docs))
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # a row is one event of its own message; equal rows stay apart by a copy number
    same = rows.groupBy("conv_id", "turn", "role", "text").count()
    events = (same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
              .withColumn("who", F.col("role")).withColumn("said", F.col("text"))
              .withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message")))
    records = chat.format_chats(events, "conv_id", ["turn", "who", "said", "copy"])
    return chat.digest(records, "conv_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of the five-word shingles of a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=1)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its more frequent form one edit away."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest tree of all documents, and a proof of each row; a seventh of the rows is tampered with on the way."""
    docs = table(spark, sf_dir, "documents")
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    told = merkle.leaf_digest(cols)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    forged = merkle.leaf_digest([*cols[:3], F.col("n_chars") + 1, cols[4]])
    return merkle.manifest(docs, "doc_id", "lang", told, F.when(hit, forged).otherwise(told))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_licence_scan, op3_token_files, op4_bpe, op5_html_text, op6_topk, op7_simhash,
    op8_language_id, op9_chat_format, op10_decontaminate, op11_packing, op12_spelling_variants, op13_merkle_manifest, pipeline)}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op2_sql() -> str:
    rows = ",\n".join(f"({_sql(a)}, {_sql(b)}, {_sql(c)})" for a, b, c in licences.TEMPLATES)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
with t as (select licence, part, {_WORDS.format('template')} as w from (values {rows}) v(licence, part, template)),
tb as (select licence, part, {grams} as b from t where len(w) > 1),
lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l, coalesce(text, '') as s from documents),
p as (select doc_id, unnest(range(len(l))) as line, unnest(l) as s from lines
      union all select doc_id, -1, s from lines where len(l) > 1),
pw as (select doc_id, line, {_WORDS.format('s')} as w from p),
pb as (select doc_id, line, {grams} as b from pw where len(w) > 1),
scored as (select doc_id, line, licence, part, 2.0 * len(list_intersect(pb.b, tb.b)) / (len(pb.b) + len(tb.b)) as dice
           from pb join tb on len(pb.b) <= 1.5 * len(tb.b) + 1e-9 and len(tb.b) <= 1.5 * len(pb.b) + 1e-9),
best as (select *, row_number() over (partition by doc_id, line order by dice desc, licence, part) as rn
         from scored where dice >= 0.8 - 1e-12)
select doc_id, cast(line as int) as line, licence, part, round(cast(dice as double), 6) as dice from best where rn = 1"""


_OP6 = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
      from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from s)
select query_id, cast(rn as int) as rank, vec_id, score from r where rn <= 20"""

_ESC = "replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
_OP9 = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + {len(chat.START) + len(chat.BODY) + len(chat.END)}) as bigint) as formatted_chars
from c group by conv_id"""

_OP10 = f"""
with i as (select item_id, {_WORDS.format('text')} as w from benchmark),
sh as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as s from i where len(w) >= 5),
n as (select item_id, count(*) as n_shingles from sh group by item_id),
d as (select doc_id, {_WORDS.format('text')} as w from documents),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as s from d where len(w) >= 5),
hit as (select doc_id, item_id, count(*) as n_shared from ds join sh using (s) group by all)
select doc_id, item_id, n_shared, n_shingles, round(cast(n_shared as double) / n_shingles, 6) as containment
from hit join n using (item_id) where n_shared >= 0.8 * n_shingles - 1e-9"""

#: In order: checksums of ``doc_id:word`` byte by byte, words, words that share all letters but one, forms, where they end.
_OP12 = """
with recursive
step(b, k, v) as (
  select b, 0, cast(b as bigint) from range(256) r(b)
  union all select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from step where k < 8),
tab as materialized (select b, v from step where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as r from documents),
low as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from runs),
occ as materialized (select doc_id, w, count(*) as n from low group by all),
keys as materialized (select doc_id, w, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || w)) as s from occ),
crc(doc_id, w, s, k, v) as (
  select doc_id, w, s, 0, cast(4294967295 as bigint) from keys
  union all select doc_id, w, s, k + 1, xor(c.v // 256, t.v)
  from crc c join tab t on t.b = xor(c.v % 256, cast('0x' || substr(s, 2 * k + 1, 2) as int)) where 2 * k < length(s)),
h as (select doc_id, w, xor(v, 4294967295) as h from crc where 2 * k = length(s)),
m as (select case when h % 97 = 0 then substr(occ.w, 1, cast(h % length(occ.w) as int)) || substr(occ.w, cast(h % length(occ.w) as int) + 2) else occ.w end as word, n
      from occ join h on h.w = occ.w and h.doc_id is not distinct from occ.doc_id),
v as materialized (select word, sum(n)::bigint as n from m where length(word) >= 5 group by word having sum(n) >= 3),
cut as materialized (select word, n, i, substr(word, 1, cast(i as int)) || substr(word, cast(i as int) + 2) as c
      from (select word, n, unnest(range(length(word))) as i from v)),
near as (select a.word, b.word as other, b.n from cut a join cut b on a.i = b.i and a.c = b.c and a.word <> b.word
         union select a.word, b.word, b.n from cut a join v b on a.c = b.word
         union select b.word, a.word, a.n from cut a join v b on a.c = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as top from near group by word),
form as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when top >= 2 * v.n then other end as form,
                case when top >= 2 * v.n then top end as form_n from v left join best using (word)),
up(word, root, form) as (
  select word, word, form from form
  union all select u.word, f.word, f.form from up u join form f on f.word = u.form)
select f.word, f.form, u.root, f.n, f.n_near, f.form_n from form f join up u on u.word = f.word and u.form is null"""


#: In order: checksums of the ids bit by bit, leaves, levels of every tree, of the tree over their roots, and the climb.
_OP13 = """
with recursive
step(b, k, v) as (
  select b, 0, cast(b as bigint) from range(256) r(b)
  union all select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from step where k < 8),
tab as (select b, v from step where k = 8),
crc(doc_id, s, k, v) as (
  select distinct doc_id, cast(doc_id as varchar), 0, cast(4294967295 as bigint) from documents where doc_id is not null
  union all select doc_id, s, k + 1, xor(c.v // 256, t.v) from crc c join tab t on t.b = xor(c.v % 256, ascii(substr(s, k + 1, 1))) where k < length(s)),
hit as (select doc_id from crc where k = length(s) and xor(v, 4294967295) % 7 = 0),
d as (select doc_id, source, lang, n_chars, text, doc_id in (select doc_id from hit) as hit from documents),
f as (select doc_id, lang, hit, n_chars,
  {0} || {1} || {2} as a, {3} as n, {4} as more, {5} as z from d),
leaf as (select doc_id, lang, sha256(a || n || z) as digest, sha256(a || case when hit then more else n end || z) as altered from f),
num as (select *, row_number() over (partition by lang order by doc_id nulls first, digest) - 1 as pos from leaf),
lv(lang, k, pos, digest, n) as (
  select lang, 0, pos, digest, count(*) over (partition by lang) from num
  union all
  select lang, k + 1, pos // 2, string_agg_hash, (n + 1) // 2 from (
    select lang, k, n, pos, case when pos % 2 = 0 then sha256(digest || coalesce(lead(digest) over (partition by lang, k order by pos), '')) end as string_agg_hash
    from lv where n > 1) where pos % 2 = 0),
sub as (select lang, digest as subroot, k as depth from lv where n = 1),
tops as (select subroot, lang, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from sub),
tv(k, pos, digest, n) as (
  select 0, pos, subroot, n from tops
  union all
  select k + 1, pos // 2, x, (n + 1) // 2 from (
    select k, n, pos, case when pos % 2 = 0 then sha256(digest || coalesce(lead(digest) over (partition by k order by pos), '')) end as x
    from tv where n > 1) where pos % 2 = 0),
root as (select digest as root from tv where n = 1),
nodes as (select 0 as top, lang, k, pos, digest, n from lv union all select 1, null, k, pos, digest, n from tv),
ids as (select num.*, row_number() over () as id from num),
climb(id, lang, top, k, pos, x, told, subroot) as (
  select id, lang, 0, 0, pos, altered, '', null::varchar from ids
  union all
  select c.id, c.lang, case when m.n = 1 then 1 else c.top end, case when m.n = 1 then 0 else c.k + 1 end,
    case when m.n = 1 then t.pos else c.pos // 2 end,
    case when m.n = 1 then c.x when s.digest is null then sha256(c.x) when c.pos % 2 = 1 then sha256(s.digest || c.x) else sha256(c.x || s.digest) end,
    case when m.n = 1 then c.told else c.told || coalesce(s.digest, '') end,
    case when m.n = 1 then m.digest else c.subroot end
  from climb c
  join nodes m on m.top = c.top and (c.top = 1 or m.lang is not distinct from c.lang) and m.k = c.k and m.pos = c.pos and (m.n > 1 or c.top = 0)
  left join nodes s on s.top = c.top and (c.top = 1 or s.lang is not distinct from c.lang) and s.k = c.k and s.pos = xor(c.pos, 1)
  join tops t on t.lang is not distinct from c.lang),
done as (select c.* from climb c join tv on tv.n = 1 and c.top = 1 and c.k = tv.k)
select doc_id, ids.digest as leaf, subroot, root, sha256(told) as proof_sha256, x as folded_root, x = root as verified
from done join ids using (id), root"""


def _op13_sql() -> str:
    def field(x: str) -> str:
        return f"coalesce(octet_length(encode(cast({x} as varchar))) || ':' || cast({x} as varchar), '-')"

    return _OP13.format(*map(field, ("doc_id", "source", "lang", "n_chars", "(n_chars + 1)", "text")))


ORACLE = {"op2_licence_scan": _op2_sql(), "op6_topk": _OP6, "op9_chat_format": _OP9, "op10_decontaminate": _OP10, "op12_spelling_variants": _OP12,
          "op13_merkle_manifest": _op13_sql()}
