"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, hard_negatives, lines, ngram_join, packing, pieces, quality, resample, secrets, shared, site_tree, token_store, warc


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (unsigned, ids as little-endian 32-bit integers) and whether decoding gives the text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(shared.table(spark, sf_dir, "pages"), shared.new_folder(spark, "warc"))
    back = warc.read_warc(manifest, with_payload=False)
    sound = F.when(F.col("error").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), "error")).cast("long"))
    return back.withColumn("payload_bytes", sound).select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP2_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as hex, min(page_id) over (partition by sha1(payload)) as first from p),
b as (select *, list_reduce(list_transform(range(40), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), lambda x, y: x || y) as bits from d)
select page_id, payload_bytes,
  list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(5), lambda j: (bits[i * 5 + j + 1] = '1')::int * (16 >> j::int)))::int]), lambda x, y: x || y) as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type,
  case when first = page_id then null else first end as refers_to
from b
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = shared.stage(quality.measure(docs, drop_text=True, name="stats"), "measured")
    told = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(measured, name="stats", out="verdict").select("doc_id", *(F.col(f"stats.{c}") for c in told), "verdict.base_failed", "verdict.kept", "verdict.distance2")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes_of(shared.table(spark, sf_dir, "documents"), n=3, percent=90).drop("row", "comp")


OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
g as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(len(words) - 2), lambda i: words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) end as grams from w),
x as (select doc_id, len(grams) as n, unnest(grams) as gram from g),
p as (
  select a.doc_id as a, b.doc_id as b from x a join x b on a.gram = b.gram and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a)
select g.doc_id, len(grams)::bigint as n_shingles, least(g.doc_id, m.least) as component_id
from g join (select a, min(b) as least from r group by a) m on m.a = g.doc_id
"""


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_ngram_join with n_links, the number of documents that each is linked to."""
    return ngram_join.classes_of(shared.table(spark, sf_dir, "documents"), n=3, percent=90, links_col="n_links").drop("row", "comp")


OP4_LINKS_SQL = OP4_SQL.replace(" as component_id\n", " as component_id, (select count(*) from e where e.a = g.doc_id) as n_links\n")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(shared.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = site_tree.extract(shared.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_store(shared.table(spark, sf_dir, "documents"), shared.new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(manifest, digest=True)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(1).selectExpr("-7L as conv_id", f"transform(array('user', 'assistant'), r -> named_struct('role', r, 'content', '{PROBE}')) as messages")
    turns = chat.canonical_turns(shared.table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(probe))
    back = chat.read_chats(chat.format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = "</s>[INST] ok [/INST]"


def _escaped_sql(text: str) -> str:
    for control, name in [("&", "&amp;"), *chat.CONTROL.items()]:
        text = f"replace({text}, '{control}', '{name}')"
    return text


OP8_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, r, '{PROBE}' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
w as (
  select *, '{chat.START}' || replace({_escaped_sql("role")}, chr(10), '&nl;') || chr(10) || {_escaped_sql("text")} || '{chat.END}' || chr(10) as written from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(written))::bigint as formatted_chars
from w group by conv_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, out="told").select("doc_id", F.col("told.lines").alias("n_lines"), F.col("told.removed").alias("n_removed"), "text")


def _resampled(spark: SparkSession, sf_dir: str, orders: tuple[int, int]) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample.resample(docs, shared.table(spark, sf_dir, "benchmark").select("text"), orders)
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir, (1, 1))


def op11_resampling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_resampling with runs of one and two words as features."""
    return _resampled(spark, sf_dir, (1, 2))


#: CRC-32 of distinct features by a table of bytes, then counts, gains and draws. Lists are numbered from 1.
OP11_SQL = r"""
with l as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
x as (select doc_id, unnest(RUNS) as f from l),
y as (select unnest(RUNS) as f from b),
c as (select list(v order by i) as crc from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as i))),
h as (select f, hex(encode(f)) as hex from (select f from x union select f from y)),
o as (select f, list_transform(range(length(hex) // 2), lambda i: (strpos('0123456789ABCDEF', hex[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex[2 * i + 2]) - 1) as bytes from h),
k as (select f, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, z: xor(a >> 8, crc[(xor(a, z) & 255) + 1])), 4294967295) % 10000 as bucket from o, c),
s as (select bucket, count(*) as s from x join k using (f) group by bucket),
t as (select bucket, count(*) as t from y join k using (f) group by bucket),
n as (select (select count(*) from x)::double as s_all, (select count(*) from y)::double as t_all),
g as (select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * (s_all + 10000) / ((s.s::double + 1) * (t_all + 10000))))::bigint as gain from s left join t using (bucket), n),
d as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from x join k using (f) join g using (bucket) group by doc_id),
u as (select *, left(sha256('2024:' || doc_id), 8) as hex8 from l left join d using (doc_id)),
v as (select doc_id, len(w) as words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, list_reduce(list_transform(range(8), lambda i: strpos('0123456789abcdef', hex8[i + 1]) - 1), lambda a, z: a * 16 + z)::double as h from u),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from v),
r as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id) as place, count(*) over (partition by words >= 20) as n from z)
select doc_id, n_features, weight, score, case when words >= 20 and place <= 10 * n // 100 then place end as rank from r
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(shared.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding::double[], lambda x: floor(256 * x)) as x from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 3
"""


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), out="spans", drop_text=True)
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    base = [kind for kind, *_ in secrets.PATTERNS]
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(of(*base)), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_sentencepiece": op1_sentencepiece, "op2_warc": op2_warc, "op3_quality": op3_quality, "op4_ngram_join": op4_ngram_join, "op4_ngram_links": op4_ngram_links, "op5_ann": op5_ann, "op6_site_tree": op6_site_tree, "op7_token_store": op7_token_store, "op8_chat": op8_chat, "op9_packing": op9_packing, "op10_line_dedup": op10_line_dedup, "op11_resampling": op11_resampling, "op11_resampling_pairs": op11_resampling_pairs, "op12_hard_negatives": op12_hard_negatives, "op13_secrets": op13_secrets}
SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op4_ngram_join": OP4_SQL, "op4_ngram_links": OP4_LINKS_SQL, "op8_chat": OP8_SQL, "op11_resampling": OP11_SQL.replace("RUNS", "w"), "op11_resampling_pairs": OP11_SQL.replace("RUNS", "list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))"), "op12_hard_negatives": OP12_SQL}
