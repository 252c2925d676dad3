"""Registered queries of the engine, each with SQL for the same rows where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import nested
from .functions import text as X
from .functions import vocabulary as V
from .operators import dialog, fusion, lexical, metrics, names, segments, structured, vectors
from .plans import engine, report, simulator, testbed
from .plans.config import Config
from .sources.catalog import last_wins, with_features
from .sources.keyed import KeyedTable
from .sources.staging import shared_dir, written
from .streaming.dialogs import dialog_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


c = F.col
PART = "(select *, case when p_size % 5 > 0 then p_size * 2.0::double end as price, " + testbed.SQL_MESSAGE + " as text from part)"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _first(text: str, words) -> str:
    return "case " + " ".join(f"when contains(lower({text}), '{w}') then '{w}'" for w in words) + " end"


def _all(text: str, words) -> str:
    return f"list_filter([{_quoted(words)}], lambda t: contains(lower({text}), t))"


def _terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ({_quoted(V.FIELDED_STOP_WORDS)}))"


def _words(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t not in ({_quoted(V.ENGLISH_STOP_WORDS)}))"


SIZE_SQL = V.SIZE.replace("'", "''")
MATERIAL_SQL, COLOR_SQL = _first("text", V.MATERIALS), _first("text", V.COLORS)
SIZE_OF = f"nullif(lower(regexp_extract(text, '(?i){SIZE_SQL}', 1)), '')"
BUDGET_OF = rf"nullif(regexp_extract(text, '{V.BUDGET_AMOUNT}', 1), '')::double"
BUCKET_OF = "case when price < 25 then 'budget' when price < 75 then 'mid' when price is not null then 'premium' end"
CLASS_SQL = (
    "case when contains(lower(v), 'budget') or regexp_matches(lower(v), '" + V.BUDGET_MENTION + "') then 'budget' "
    + " ".join("when " + " or ".join(f"contains(lower(v), '{m}')" for m in marks) + f" then '{name}'" for name, marks in V.CONSTRAINT_CLASSES.items())
    + " when v is not null then 'feature' end"
)


# Text views and extraction


@query("select p_partkey, concat_ws(' ', p_name, concat(p_name, ' by ', p_brand), concat('Clothing, Shoes & Jewelry ', p_type, ' ', p_brand)) as lexical_text from part")
def text_view_lexical(spark, d):
    return testbed.catalog(spark, d).select(c("ord").alias("p_partkey"), X.lexical_text(c("title"), c("description"), c("categories")).alias("lexical_text"))


@query("select doc_id, left(concat_ws(' ', nullif(source, ''), nullif(text, ''), nullif(lang, ''), 'Texts'), 500) as dense_text from documents")
def text_view_dense_cap(spark, d):
    docs = testbed.table(spark, d, "documents")
    return docs.select("doc_id", X.dense_text(c("source"), F.array("text"), F.array("lang"), F.array(F.lit("Texts"))).alias("dense_text"))


@query("select p_partkey, concat_ws(' ', p_name, p_type, concat('size ', p_size), concat('Brand ', p_brand), concat('Finish ', p_type), concat(p_name, ' by ', p_brand), 'Clothing, Shoes & Jewelry', p_type, p_brand, p_brand) as searchable_text from part")
def searchable_text(spark, d):
    fields = ("title", "features", "details", "description", "categories", "store")
    return testbed.catalog(spark, d).select(c("ord").alias("p_partkey"), X.searchable_text(*map(c, fields)).alias("searchable_text"))


@query(f"with t as (select doc_id, {_terms('text')} as t from documents) select doc_id, len(t)::int as n_terms, array_to_string(t, ' ') as terms from t")
def tokenize_terms(spark, d):
    docs = testbed.table(spark, d, "documents").select("doc_id", X.query_terms(c("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@query(f"with t as (select doc_id, {_terms('text')} as t from documents), u as (select doc_id, list_filter(t, lambda x, i: list_position(t, x) = i)[:40] as u from t) select doc_id, array_to_string(list_transform(u, lambda x: '\"' || x || '\"'), ' OR ') as expression from u")
def unique_terms_cap(spark, d):
    return testbed.table(spark, d, "documents").select("doc_id", X.match_expression(c("text")).alias("expression"))


@query(r"select doc_id, rtrim(left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^[ \-;,.]+|[ \-;,.]+$', '', 'g'), 180)) as cleaned from documents")
def clean_constraint(spark, d):
    return testbed.table(spark, d, "documents").select("doc_id", X.clean_constraint(c("text")).alias("cleaned"))


@query(f"select p_partkey, {MATERIAL_SQL} as material, {COLOR_SQL} as color from {PART}")
def extract_material_vocab_order(spark, d):
    return testbed.messages(spark, d).select("p_partkey", X.material(c("text")).alias("material"), X.color(c("text")).alias("color"))


@query(rf"select p_partkey, nullif(lower(regexp_extract(text, '(?i)\b({'|'.join(V.CARD_COLORS)})\b', 1)), '') as color, nullif(lower(regexp_extract(text, '(?i)\b({'|'.join(V.CARD_MATERIALS)})\b', 1)), '') as material from {PART}")
def extract_color_first_position(spark, d):
    return testbed.messages(spark, d).select("p_partkey", X.first_by_place(c("text"), V.CARD_COLORS).alias("color"), X.first_by_place(c("text"), V.CARD_MATERIALS).alias("material"))


@query(f"select p_partkey, {SIZE_OF} as size, nullif(lower(regexp_extract(text, '(?i){SIZE_SQL.replace('|s|m|l|', '|')}', 1)), '') as strict_size from {PART}")
def extract_size(spark, d):
    return testbed.messages(spark, d).select("p_partkey", X.size(c("text")).alias("size"), X.size(c("text"), strict=True).alias("strict_size"))


@query(f"select p_partkey, {BUDGET_OF} as budget from {PART}")
def extract_budget(spark, d):
    return testbed.messages(spark, d).select("p_partkey", X.budget(c("text")).alias("budget"))


@query(f"select p_partkey, {BUCKET_OF} as bucket from {PART}")
def price_bucket(spark, d):
    return testbed.catalog(spark, d).select(c("ord").alias("p_partkey"), X.price_bucket(c("price")).alias("bucket"))


FEATURES = f"(select *, concat(p_name, ' ', p_type, ' size ', p_size) as feature_text from {PART})"


@query(f"select p_partkey, concat_ws('|', {_first('feature_text', V.MATERIALS)}, {_first('feature_text', V.COLORS)}, {BUCKET_OF}) as feature_values from {FEATURES}")
def feature_values(spark, d):
    return testbed.catalog(spark, d).select(c("ord").alias("p_partkey"), F.array_join(X.feature_values(c("title"), c("features"), c("price")), "|").alias("feature_values"))


DETAILS = """concat('{"Brand": "', p_brand, '", "Size": ', p_size, ', "Large": ', case when p_size > 25 then 'true' else 'false' end, ', "Weight": ', p_size, '.50, "Gone": null, "Blank": "", "Empty": [], "Sizes": ["', p_size, '", ', p_size, ', null], "Box": {"of": "', p_type, '", "its": [], "in": {"n": ', p_size, '}}}')"""
SHOWN_SQL = """
  'Brand: ' || (j ->> '$.Brand'), 'Size: ' || (j ->> '$.Size'), 'Large: ' || case when (j ->> '$.Large') = 'true' then 'True' else 'False' end, 'Weight: ' || (j ->> '$.Weight')::double,
  'Sizes: [' || chr(39) || (j ->> '$.Sizes[0]') || chr(39) || ', ' || (j ->> '$.Sizes[1]') || ', None]',
  'Box: {' || chr(39) || 'of' || chr(39) || ': ' || chr(39) || (j ->> '$.Box.of') || chr(39) || ', ' || chr(39) || 'its' || chr(39) || ': [], ' || chr(39) || 'in' || chr(39) || ': {' || chr(39) || 'n' || chr(39) || ': ' || (j ->> '$.Box.in.n') || '}}'"""


@query(f"select p_partkey, concat_ws('|', {SHOWN_SQL}) as flattened from (select p_partkey, {DETAILS}::json as j from part)")
def flattened_details(spark, d):
    made = testbed.table(spark, d, "part").selectExpr("p_partkey", f"{DETAILS} as j")
    return made.select("p_partkey", F.array_join(nested.flattened(c("j")), "|").alias("flattened"))


@query("select p_partkey, concat(p_type, ' ', p_brand) as category from part")
def coarse_category(spark, d):
    return testbed.catalog(spark, d).select(c("ord").alias("p_partkey"), X.coarse_category(c("categories")).alias("category"))


@query(f"select p_partkey, {CLASS_SQL} as class from (select p_partkey, text as v from {PART})")
def classify_constraint(spark, d):
    return testbed.messages(spark, d).select("p_partkey", X.classify_constraint(c("text")).alias("class"))


@query(f"select p_partkey, array_to_string({_all('text', V.MATERIALS)}, '|') as materials, array_to_string({_all('text', V.COLORS)}, '|') as colors, {BUDGET_OF} as budget from {PART}")
def extract_constraints(spark, d):
    found = testbed.messages(spark, d).select("p_partkey", structured.constraints(c("text")).alias("k"))
    return found.select("p_partkey", F.array_join("k.materials", "|").alias("materials"), F.array_join("k.colors", "|").alias("colors"), c("k.budget").alias("budget"))


# Retrieval and ranking


@query(f"select count(*) as n, round(avg(len({_words('text')})), 6) as mean from documents")
def corpus_stats(spark, d):
    return lexical.corpus_stats(testbed.table(spark, d, "documents"), lexical.plain_words("text")).select("n", F.round("mean", 6).alias("mean"))


@query(f"""
with t as (select doc_id, {_words('text')} as t from documents),
s as (select count(*) as n, avg(len(t)) as mean from t),
p as (select doc_id, len(t) as dl, unnest(t) as term from t),
tf as (select doc_id, term, dl, count(*)::double as tf from p group by all),
q as (select item_id, unnest({_words('text')}) as term from benchmark),
qt as (select item_id, term, count(*) as times from q group by all),
df as (select term, count(*) as df from tf group by term),
r as (select qt.item_id as query_id, tf.doc_id, sum(qt.times * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * (tf.tf / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / s.mean)))) as score
  from qt join tf using (term) join df using (term), s group by all),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id)::int as rank from r where score > 0)
select query_id, doc_id, round(score, 6) as score, rank from k where rank <= 10
""")
def lexical_bm25_topk(spark, d):
    docs, tokens = testbed.table(spark, d, "documents"), lexical.plain_words("text")
    queries = lexical.terms_of(testbed.table(spark, d, "benchmark"), "item_id", tokens)
    made = lexical.index(lexical.postings(docs, "doc_id", tokens), lexical.corpus_stats(docs, tokens), terms=queries)
    found = lexical.top_k(made, queries, 10)
    return found.select("query_id", c("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(SQL["lexical_bm25_topk"])
def lexical_bm25_segments(spark, d):
    """The rows of lexical_bm25_topk by an index that grew: two halves, a deletion, the deleted documents again."""
    docs, tokens = testbed.table(spark, d, "documents"), lexical.plain_words("text")
    grown = segments.Segments(spark, f"{shared_dir(spark)}/parley/segments-{uuid.uuid4().hex}")
    grown.add(docs.where("doc_id % 2 = 0"), "doc_id", tokens)
    grown.add(docs.where("doc_id % 2 <> 0"), "doc_id", tokens)
    grown.delete(docs.where("doc_id % 10 = 0").select(c("doc_id").alias("id")))
    grown.add(docs.where("doc_id % 10 = 0"), "doc_id", tokens)
    queries = lexical.terms_of(testbed.table(spark, d, "benchmark"), "item_id", tokens)
    found = lexical.top_k(lexical.index(grown.postings(), grown.stats(), terms=queries), queries, 10)
    return found.select("query_id", c("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"""
with f as (select p_partkey, {_terms('p_name')} as a, {_terms('p_type')} as b, {_terms('p_brand')} as e from part),
s as (select count(*) as n, avg(len(a) + len(b) + len(e)) as mean from f),
o as (select p_partkey, len(a) + len(b) + len(e) as dl, unnest(a) as term, 6.0 as w from f
  union all select p_partkey, len(a) + len(b) + len(e), unnest(b), 4.0 from f union all select p_partkey, len(a) + len(b) + len(e), unnest(e), 1.5 from f),
tf as (select p_partkey, term, dl, sum(w)::double as tf from o group by all),
q as (select min(p_partkey) as query_id, unnest({_terms("p_name || ' ' || p_name")}) as term from part group by p_name),
qt as (select distinct query_id, term from q),
df as (select term, count(*) as df from tf group by term),
r as (select query_id, p_partkey, sum(greatest(ln((s.n - df + 0.5) / (df + 0.5)), 1e-6) * (tf / (tf + 1.2 * (0.25 + 0.75 * dl / s.mean)))) as score
  from qt join tf using (term) join df using (term), s group by all),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, p_partkey)::int as rank from r)
select query_id, p_partkey, round(score, 6) as score, rank from k where rank <= 10
""")
def fielded_bm25_topk(spark, d):
    parts = testbed.table(spark, d, "part")
    fields = {f: X.query_terms(c(f)) for f in ("p_name", "p_type", "p_brand")}
    weighted = {f: (t, V.FIELD_WEIGHTS[n]) for (f, t), n in zip(fields.items(), ("title", "categories", "store"), strict=True)}
    asked = parts.groupBy("p_name").agg(F.min("p_partkey").alias("query_id"))
    queries = lexical.terms_of(asked, "query_id", X.unique_terms(c("p_name")))
    stats = lexical.corpus_stats(parts, F.concat(*fields.values()))
    made = lexical.index(lexical.field_postings(parts, "p_partkey", weighted), stats, lexical.FIELDED)
    found = lexical.top_k(made, queries, 10)
    return found.select("query_id", c("id").alias("p_partkey"), F.round("score", 6).alias("score"), "rank")


@query("""
with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 100 = 0),
r as (select query_id, vec_id, list_inner_product(q.e, embeddings.embedding::double[]) as score from q, embeddings),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id)::int as rank from r)
select query_id, vec_id, round(score, 6) as score, rank from k where rank <= 10
""")
def dense_topk(spark, d):
    rows = testbed.table(spark, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").cast("array<double>").alias("v"))
    queries = rows.where("id % 100 = 0").select(c("id").alias("query_id"), "v")
    return vectors.search(rows, queries, 10).select("query_id", c("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


SCORE_SQL = "len(list_filter(list_concat({m}, {k}), lambda t: contains({text}, t)))::double + case when price <= {b} then 0.5 when price > {b} then -0.5 * least((price - {b}) / {b}, 1.0) else 0.0 end + case when contains({low}, lower(p_brand)) then 1.0 else 0.0 end"


@query(f"select p_partkey, round({SCORE_SQL.format(m=_all('text', V.MATERIALS), k=_all('text', V.COLORS), text='lower(feature_text)', b=BUDGET_OF, low='lower(text)')}, 6) as score from {FEATURES}")
def structured_score(spark, d):
    parts = with_features(testbed.catalog(spark, d)).join(testbed.messages(spark, d).withColumnRenamed("p_partkey", "ord"), "ord")
    k = structured.constraints(c("text"))
    return parts.select(c("ord").alias("p_partkey"), F.round(structured.score(c("match_text"), c("store_text"), c("price"), k), 6).alias("score"))


NATION_SAYS = "concat('A red or tan suede item from ', case when n_nationkey % 2 = 0 then 'Brand#1' || (1 + n_nationkey % 5) else 'anyone' end, case when n_nationkey % 3 > 0 then ', under $' || (10 + n_nationkey) else '' end)"


@query(f"""
with q as (select n_nationkey as query_id, {NATION_SAYS} as text from nation),
x as (select query_id, text as said, {_all('text', V.MATERIALS)} as m, {_all('text', V.COLORS)} as k, {BUDGET_OF} as b from q),
r as (select query_id, p_partkey, {SCORE_SQL.format(m='m', k='k', text='lower(feature_text)', b='b', low='lower(said)')} as score from x, {FEATURES}),
t as (select *, row_number() over (partition by query_id order by score desc, p_partkey)::int as rank from r where score > 0)
select query_id, p_partkey, round(score, 6) as score, rank from t where rank <= 10
""")
def structured_topk(spark, d):
    products = with_features(testbed.catalog(spark, d)).withColumn("id", c("ord"))
    queries = testbed.table(spark, d, "nation").selectExpr("n_nationkey as query_id", f"{NATION_SAYS} as text")
    return structured.search(products, queries, 10).select("query_id", c("id").alias("p_partkey"), F.round("score", 6).alias("score"), "rank")


@query("""
with n as (select distinct unnest(string_split(lower(text), ' ')) as name from benchmark),
f as (select doc_id, name from documents, n where name <> '' and contains(lower(text), name))
select doc_id, count(*) as n, string_agg(name, ' ' order by name) as names from f group by doc_id
""")
def store_mentions(spark, d):
    """The words of all benchmark texts as names, in all documents."""
    words = testbed.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("store_text"))
    texts = testbed.table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    found = names.names_in(texts, words, "doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("store_text")), " ").alias("names"))


def _routes(spark, d):
    parts = testbed.table(spark, d, "part")
    a = parts.selectExpr("p_brand as query_id", "p_partkey as id", "row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank")
    b = parts.where("p_size > 10").selectExpr("p_brand as query_id", "p_partkey as id", "row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank")
    return a, b


ROUTES_SQL = """
a as (select p_brand as query_id, p_partkey as id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part),
b as (select p_brand as query_id, p_partkey as id, row_number() over (partition by p_brand order by p_size desc, p_partkey) as rank from part where p_size > 10)"""
FUSED_SQL = "with" + ROUTES_SQL + """,
f as (select query_id, id, coalesce({wa} / (60 + a.rank), 0.0) + coalesce({wb} / (60 + b.rank), 0.0) as score, case when a.rank is not null {first} then 0 else 1 end as route, a.rank as ra, b.rank as rb from a full join b using (query_id, id))
select query_id, id, round(score, 9) as score, row_number() over (partition by query_id order by score desc, route, case when route = 0 then ra else rb end)::int as rank from f"""


@query(FUSED_SQL.format(wa="2.0::double", wb="1.0::double", first=""))
def rrf_fusion(spark, d):
    return fusion.fuse(_routes(spark, d), [2.0, 1.0]).withColumn("score", F.round("score", 9))


@query(FUSED_SQL.format(wa="1.0::double", wb="0.0::double", first="") + " where ra is not null")
def rrf_weighted_zero_route(spark, d):
    return fusion.fuse(_routes(spark, d), [1.0, 0.0]).withColumn("score", F.round("score", 9))


@query("with" + ROUTES_SQL + " select query_id, id, row_number() over (partition by query_id order by rank)::int as rank from a where (query_id, id) not in (select p_brand, p_partkey from part where p_size % 2 = 0)")
def exclude_shown_anti_join(spark, d):
    shown = testbed.table(spark, d, "part").where("p_size % 2 = 0").selectExpr("p_brand as query_id", "p_partkey as id")
    return fusion.exclude(_routes(spark, d)[0], shown)


@query("""
with k as (select l_orderkey as query_id, l_partkey::varchar as id, min(l_linenumber) as pos from lineitem join part on l_partkey = p_partkey and p_size > 10 group by all)
select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by pos, id)::int as rank from k) where rank <= 3
""")
def normalize_recommendations(spark, d):
    items = testbed.table(spark, d, "lineitem").selectExpr("l_orderkey as query_id", "l_linenumber as pos", "concat(' ', l_partkey, ' ') as id")
    known = testbed.table(spark, d, "part").where("p_size > 10").selectExpr("cast(p_partkey as string) as id")
    return fusion.normalize(items, known, 3)


@query(f"""
with recursive p as (select p_brand as query_id, p_partkey::varchar as id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank, {testbed.SQL_MESSAGE} as text, p_size * 2.0::double as price from part),
v as (select query_id, id, rank, list_filter([{MATERIAL_SQL}, {COLOR_SQL}, {BUCKET_OF}], lambda x: x is not null) as vals from p),
s as (select *, coalesce(list_sum(list_transform(vals, lambda x: case x when 'mid' then 3.0::double when 'leather' then 1.0::double else 0.0::double end)), 0.0::double) / 3.0::double as rejected from v),
w as (select greatest(0.1::double, least(0.6::double, 0.65::double - 0.05::double * 2)) as w),
r(query_id, n, ids, ranks, seen) as (
  select query_id, 1, [id], [rank], vals from s where rank = 1
  union all
  select query_id, n + 1, list_append(ids, id), list_append(ranks, rank), list_distinct(list_concat(seen, vals)) from (
    select *, row_number() over (partition by query_id order by score desc, rank) as place from (
      select r.query_id, n, ids, ranks, seen, id, rank, vals,
        1.0::double / (rank - len(list_filter(ranks, lambda x: x < rank))) * (1 - w) + w * len(list_filter(vals, lambda x: not list_contains(seen, x))) - 0.3::double * rejected as score
      from r join s on s.query_id = r.query_id, w where n < 10 and not list_contains(ids, id)))
  where place = 1),
last as (select query_id, arg_max(ids, n) as ids from r group by query_id)
select query_id, (generate_subscripts(ids, 1) - 1)::int as pos, unnest(ids) as id from last
""")
def portfolio_rerank(spark, d):
    """Each pick depends on those before it, which SQL says by recursion over whole lists."""
    pruned = fusion.prune_pool(testbed.pool(spark, d), 10)
    lists = pruned.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", c("id").cast("string").alias("id"), "values"))).alias("pool"))
    counts = F.create_map(F.lit("mid"), F.lit(3), F.lit("leather"), F.lit(1))
    picked = lists.select("query_id", fusion.cover(c("pool"), counts, fusion.diversity_weight(F.lit(2), True), 10).alias("ids"))
    return picked.select("query_id", F.posexplode("ids").alias("pos", "id"))


@query("select p_partkey, round(w, 9) as weight from (select p_partkey, case when p_size % 2 = 0 then greatest(0.1, least(0.6, 0.65 - 0.05 * (p_size % 12)))::double else 0.35::double end as w from part)")
def diversity_weight(spark, d):
    return testbed.table(spark, d, "part").select("p_partkey", F.round(fusion.diversity_weight(c("p_size") % 12, c("p_size") % 2 == 0), 9).alias("weight"))


@query("select l_orderkey, array_to_string(list_concat(list_filter(['9', l_partkey::varchar, '7', l_suppkey::varchar], lambda x: list_contains(ids, x)), list_filter(ids, lambda x: not list_contains(['9', l_partkey::varchar, '7', l_suppkey::varchar], x))), ',') as ranked, l_linenumber from (select *, [l_suppkey::varchar, 'x', l_partkey::varchar, 'y'] as ids from lineitem)")
def rerank_repair(spark, d):
    lines = testbed.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "array('9', cast(l_partkey as string), '7', cast(l_suppkey as string)) as raw", "array(cast(l_suppkey as string), 'x', cast(l_partkey as string), 'y') as ids")
    return lines.select("l_orderkey", "l_linenumber", F.array_join(fusion.repair(c("raw"), c("ids")), ",").alias("ranked"))


@query("select o_orderkey as key, case when o_orderkey % 4 = 0 then o_clerk || ',b' end as ranked, case when o_orderkey % 4 = 0 then 42 else 0 end::bigint as prompt_tokens, case when o_orderkey % 4 = 0 then 7 else 0 end::bigint as completion_tokens from (select *, o_orderstatus as o_clerk from orders)")
def rerank_fallback(spark, d):
    orders = testbed.table(spark, d, "orders")
    requests = orders.selectExpr("o_orderkey as key", "array(o_orderstatus, 'b') as ids")
    memo = orders.where("o_orderkey % 4 = 0").selectExpr("o_orderkey as key", "array(o_orderstatus, 'b') as ranked", "42L as prompt_tokens", "7L as completion_tokens")
    return fusion.rerank(requests, memo).select("key", F.array_join("ranked", ",").alias("ranked"), "prompt_tokens", "completion_tokens")


@query("""select p_partkey, sha256('{"candidates":["' || p_brand || '","' || p_partkey || '"],"model":"m","query":"' || p_name || '"}') as key from part""")
def cache_key(spark, d):
    return testbed.table(spark, d, "part").select("p_partkey", X.cache_key(F.lit("m"), c("p_name"), F.array("p_brand", c("p_partkey").cast("string"))).alias("key"))


# Session state and questions


@query("""
with u as (select conv_id, turn, text, string_agg(text, ' ') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as earlier from conversations where role = 'user')
select conv_id, turn, concat_ws(' ', text, text, earlier) as query from u
""")
def dialog_query(spark, d):
    said = testbed.table(spark, d, "conversations").where("role = 'user'")
    return dialog.dialog_queries(said, "conv_id", "turn", "text")


STREAMED_SQL = f"""
with u as (select conv_id, turn, text, {MATERIAL_SQL} as material, {COLOR_SQL} as color, {SIZE_OF} as size, {BUDGET_OF} as budget, string_agg(text, ' ') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as earlier from conversations where role = 'user'),
o as (select conv_id, turn, concat_ws(' ', text, text, earlier) as query, material as m, color as c, size as s, budget as b, {{last}}, {{before}} from u)
select conv_id, turn, query, material, color, size, budget, concat_ws('|', case when old_material <> m then 'material' end, case when old_color <> c then 'color' end, case when old_size <> s then 'size' end, case when old_budget <> b then 'budget' end) as overridden from o"""


def _held(rows: str, prefix: str) -> str:
    return ", ".join(f"last_value({a} ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and {rows}) as {prefix}{a}" for a in V.SLOTS)


@query(STREAMED_SQL.replace("{last}", _held("current row", "")).replace("{before}", _held("1 preceding", "old_")))
def streamed_dialogs(spark, d):
    """The customers' messages as a stream, their turns as seconds; a row of no session at its end moves the watermark on."""
    kinds = "array<struct<id:string,values:array<string>>>"
    at = f"{shared_dir(spark)}/parley/streamed-{uuid.uuid4().hex}"
    testbed.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text").write.parquet(f"{at}/said")
    said = spark.readStream.schema("conv_id long, turn long, text string").parquet(f"{at}/said")
    own = F.struct(c("conv_id").cast("string").alias("session_id"), "turn", F.timestamp_seconds(c("turn") + 1).alias("at"), "text")
    end = F.struct(F.lit("end").alias("session_id"), F.lit(0).cast("long").alias("turn"), F.timestamp_seconds(F.lit(1 << 31)).alias("at"), F.lit("").alias("text"))
    rows = said.select(F.explode(F.array(own, end)).alias("r")).select("r.*", F.lit(None).cast(kinds).alias("shown"))
    run = dialog_stream(rows, "0 seconds").writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.parquet(f"{at}/rows").where("session_id <> 'end'")
    return found.select(c("session_id").cast("long").alias("conv_id"), "turn", "query", *V.SLOTS, F.array_join("overridden", "|").alias("overridden"))


TURNS_SQL = f"""
with m as (select p_partkey, {MATERIAL_SQL} as material, {COLOR_SQL} as color, {SIZE_OF} as size, {BUDGET_OF} as budget from {PART}),
n as (select l_orderkey as session_id, {testbed.TURN}::int as turn, m.* from lineitem join m on l_partkey = p_partkey)"""


def _last(rows: str) -> str:
    return ", ".join(f"last_value({a} ignore nulls) over (partition by session_id order by turn rows between unbounded preceding and {rows}) as {{p}}{a}" for a in V.SLOTS)


@query(TURNS_SQL + f" select session_id, turn, {_last('current row').format(p='')} from n")
def slot_values(spark, d):
    return dialog.slot_turns(testbed.dialogues(spark, d)).drop("overridden")


@query(TURNS_SQL + f", o as (select *, {_last('1 preceding').format(p='old_')} from n) select session_id, turn, concat_ws('|', {', '.join(f'case when old_{a} <> {a} then ' + chr(39) + a + chr(39) + ' end' for a in V.SLOTS)}) as overridden from o")
def slot_overrides(spark, d):
    return dialog.slot_turns(testbed.dialogues(spark, d)).select("session_id", "turn", F.array_join("overridden", "|").alias("overridden"))


@query(f"""
with f as (select p_partkey, unnest(list_filter([{_first('feature_text', V.MATERIALS)}, {_first('feature_text', V.COLORS)}, {BUCKET_OF}], lambda x: x is not null)) as value from {FEATURES})
select l_orderkey as session_id, value, count(*) as n from lineitem join f on l_partkey = p_partkey group by all
""")
def rejection_counts(spark, d):
    shown = testbed.table(spark, d, "lineitem").selectExpr("l_orderkey as session_id", "l_partkey as id")
    products = testbed.catalog(spark, d).select(c("ord").alias("id"), X.feature_values(c("title"), c("features"), c("price")).alias("values"))
    return dialog.rejection_counts(shown, products)


@query("""
with b as (select *, max(case when l_returnflag = 'R' then l_linenumber end) over (partition by l_orderkey) as since from lineitem)
select distinct l_orderkey as session_id, l_partkey as id from b where since is null or l_linenumber >= since
""")
def shown_set(spark, d):
    batches = testbed.table(spark, d, "lineitem").selectExpr("l_orderkey as session_id", "l_linenumber as turn", "l_partkey as id", "l_returnflag = 'R' as override")
    return dialog.shown_after(batches)


POOL_SQL = f"""
p as (select p_brand as query_id, p_partkey as id, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank, {MATERIAL_SQL} as material, {COLOR_SQL} as color, {SIZE_OF} as size, {BUCKET_OF} as budget from (select * replace (p_size * 2.0::double as price) from {PART})),
l as (select query_id, rank, unnest([{', '.join(f"{{'o': {i}, 'a': '{a}', 'v': {a}}}" for i, a in enumerate(V.SLOTS))}]) as x from p),
k as (select query_id, x.o as o, x.a as attribute, x.v as v, count(x.v) as c from l {{where}} group by all),
e as (select query_id, o, attribute, case when sum(c) > 1 then log2(sum(c)) - sum(case when c > 0 then c * log2(c) else 0 end) / sum(c) else 0.0 end as entropy from k group by all)"""


@query("with" + POOL_SQL.replace("{where}", "") + " select query_id, attribute, round(entropy, 9) + 0.0 as entropy from e")
def attribute_entropy(spark, d):
    return dialog.entropy(testbed.pool(spark, d), ["query_id"], V.SLOTS).select("query_id", "attribute", F.round("entropy", 9).alias("entropy"))


FILLED = "case cast(right(p_brand, 1) as int) % 4 when 0 then array('size') when 1 then array('size', 'budget') when 2 then array('material', 'color', 'size', 'budget', 'style') else array('other') end"


@query("with" + POOL_SQL.replace("{where}", "where rank <= 50") + f""",
f as (select distinct p_brand as query_id, {FILLED.replace("array(", "list_value(")} as filled from part),
b as (select query_id, arg_max(attribute, round(entropy, 12) * 1000 - o * 1e-7) as attribute, max(entropy) as entropy from e join f using (query_id) where not list_contains(filled, attribute) group by query_id)
select f.query_id, case when round(entropy, 12) > 0.1 then attribute else list_filter(['style', 'use_case', 'feature', 'other'], lambda x: not list_contains(filled, x))[1] end as attribute from f left join b using (query_id)
""")
def choose_attribute(spark, d):
    filled = testbed.table(spark, d, "part").selectExpr("p_brand as query_id", f"{FILLED} as filled").distinct()
    return dialog.choose_attribute(testbed.pool(spark, d), filled, "query_id")


@query(f"select p_partkey, q as attribute, case when q is null then 'Here are some options based on what you''ve told me so far.' else 'Do you have a ' || q || ' preference?' end as message from (select p_partkey, list_filter([{_quoted(V.FIXED_ORDER)}], lambda x: not list_contains({FILLED.replace('array(', 'list_value(')}, x))[1] as q from part)")
def fixed_question(spark, d):
    asked = testbed.table(spark, d, "part").select("p_partkey", dialog.fixed_question(F.expr(FILLED)).alias("attribute"))
    return asked.withColumn("message", dialog.question_text(c("attribute")))


# Simulator


CARD_SQL = rf"""
t as (select p_partkey, p_name, concat_ws(' ', p_name, p_type, concat('size ', p_size), concat('Brand ', p_brand), concat('Finish ', p_type), concat(p_name, ' by ', p_brand), 'Clothing, Shoes & Jewelry', p_type, p_brand, p_brand) as corpus,
  [p_type, concat('size ', p_size), concat('Brand: ', p_brand), concat('Finish: ', p_type)] as listed, case when p_size % 5 > 0 then concat('budget around $', p_size * 2) end as priced from part),
m as (select *, nullif(lower(regexp_extract(corpus, '(?i)\b({'|'.join(V.CARD_MATERIALS)})\b', 1)), '') as material, nullif(lower(regexp_extract(corpus, '(?i)\b({'|'.join(V.CARD_COLORS)})\b', 1)), '') as color from t),
a as (select *, case when material is not null then list_prepend(material, listed) else listed end as l1 from m),
b as (select *, case when color is not null then list_concat(l1[:1], list_concat(['color: ' || color], l1[2:])) else l1 end as l2 from a),
e as (select *, case when priced is not null then list_append(l2, priced) else l2 end as l3 from b),
card as (select p_partkey, p_name as target_category, list_filter(l3, lambda x, i: list_position(l3, x) = i) as l from e)"""


@query("with" + CARD_SQL + " select p_partkey, target_category, array_to_string(l[:2], '|') as hard, array_to_string(case when len(l) > 2 then l[3:4] else l[:1] end, '|') as soft from card")
def intent_card(spark, d):
    cards = testbed.catalog(spark, d).select(c("ord").alias("p_partkey"), simulator.intent_card(*map(c, ("title", "features", "details", "description", "categories", "store", "price_text"))).alias("k"))
    return cards.select("p_partkey", "k.target_category", F.array_join("k.hard_constraints", "|").alias("hard"), F.array_join("k.soft_preferences", "|").alias("soft"))


SCENARIO = "element_at(array('buying', 'browsing', 'intent_override', 'boundary'), cast(p_partkey % 4 as int) + 1)"


def _cards(spark, d):
    scenario = testbed.table(spark, d, "part").selectExpr("p_partkey as ord", f"{SCENARIO} as scenario", "p_size")
    card = simulator.intent_card(*map(c, ("title", "features", "details", "description", "categories", "store", "price_text")))
    return testbed.catalog(spark, d).join(scenario, "ord").select(c("ord").alias("p_partkey"), "scenario", "p_size", X.coarse_category(c("categories")).alias("category"), card.alias("card"))


@query("with" + CARD_SQL + """ select p_partkey, concat('I''m looking for ', p_type, ' ', p_brand, case p_partkey % 4 when 0 then concat('. A key requirement is: ', l[1], '.') when 2 then concat('. ', case when len(l) > 3 then l[4] when len(l) > 2 then l[3] else l[1] end) else ', but I''m still exploring.' end) as message from card join part using (p_partkey)""")
def initial_message(spark, d):
    old = F.try_element_at(c("card.soft_preferences"), F.lit(-1))
    return _cards(spark, d).select("p_partkey", simulator.initial_message(c("scenario"), c("category"), c("card"), old).message.alias("message"))


ASKED = "case p_size % 6 when 0 then null when 1 then 'other' when 2 then 'color' when 3 then 'shape' when 4 then 'feature' else 'budget' end"


@query("with" + CARD_SQL + f""",
s as (select p_partkey, p_partkey % 4 = 3 as boundary, {ASKED} as asked, list_concat(l[:2], case when len(l) > 2 then l[3:4] else l[:1] end) as every, [l[1]] as told from card join part using (p_partkey)),
k as (select *, case when asked = 'shape' then 'other' else asked end as known from s),
f as (select *, list_filter(every, lambda v: not list_contains(told, v) and (known = 'other' or {CLASS_SQL} = known))[:2] as fits from k)
select p_partkey, case when boundary and asked is not null then concat('I don''t have a preference for ', asked, '; please use your judgment.')
  when asked is null then 'Those options are not quite right yet. Ask me about one specific attribute.'
  when len(fits) = 0 then concat('I don''t have an additional preference for ', known, '.')
  else concat('For that, what matters is: ', array_to_string(fits, '; '), '.') end as message from f
""")
def customer_reply(spark, d):
    told = F.slice(c("card.hard_constraints"), 1, 1)
    return _cards(spark, d).select("p_partkey", simulator.customer_reply(c("scenario"), c("card"), F.expr(ASKED), told, F.lit(False)).message.alias("message"))


# Aggregates of results


SESSIONS_SQL = "(select o_orderpriority as scenario_type, (o_orderkey % 13 < 5) as hit, (o_orderkey % 13 < 5 or o_orderkey % 3 = 0) as deep, case when o_orderkey % 13 < 5 then 1 + o_orderkey % 10 end as t, case when o_orderkey % 13 < 5 then 1.0::double / (1 + o_custkey % 10) else 0.0 end as rr from orders)"
SUMMARY_SQL = "count(*) as sample_count, round(avg(hit::int), 9) as hit_rate_at_10, round(avg(rr), 9) as mrr, round(avg(coalesce(t, 11)), 9) as mttc"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names or ("hit_rate_at_10", "mrr", "mttc")})


@query(f"select {SUMMARY_SQL} from {SESSIONS_SQL}")
def metric_summary(spark, d):
    return _rounded(metrics.metric_summary(testbed.sessions(spark, d)))


@query(f"select scenario_type, {SUMMARY_SQL} from {SESSIONS_SQL} group by scenario_type")
def scenario_metrics(spark, d):
    return _rounded(metrics.scenario_metrics(testbed.sessions(spark, d)))


@query(f"select scenario_type, {SUMMARY_SQL} from {SESSIONS_SQL} group by grouping sets ((), (scenario_type))")
def metric_grouping_sets(spark, d):
    return _rounded(metrics.grouping_sets(testbed.sessions(spark, d)))


@query(f"with m as (select avg(hit::int) as h, avg(rr) as r, avg(coalesce(t, 11)) as m from {SESSIONS_SQL}) select round(greatest(0, least(1, (11 - m) / 10)), 9) as efficiency, round(0.5 * h + 0.3 * r + 0.2 * greatest(0, least(1, (11 - m) / 10)), 9) as technical_score from m")
def technical_score(spark, d):
    return _rounded(metrics.with_scores(metrics.metric_summary(testbed.sessions(spark, d))).select("efficiency", "technical_score"), "efficiency", "technical_score")


@query(f"""select count(*) as sample_count, round(avg(hit::int), 9) as official_hit_rate_at_10, round(avg(deep::int), 9) as recall_at_k, count(*) filter (not hit) as miss_count,
  count(*) filter (not hit and not deep) as retrieval_failure_count, round(count(*) filter (not hit and not deep) / count(*) filter (not hit), 9) as retrieval_failure_fraction_of_misses,
  count(*) filter (not hit and deep) as ranking_failure_count, round(count(*) filter (not hit and deep) / count(*) filter (not hit), 9) as ranking_failure_fraction_of_misses from {SESSIONS_SQL}""")
def recall_probe_split(spark, d):
    return _rounded(metrics.recall_probe(testbed.sessions(spark, d)), "official_hit_rate_at_10", "recall_at_k", "retrieval_failure_fraction_of_misses", "ranking_failure_fraction_of_misses")


@query("with u as (select sum(o_custkey % 100 - 5) filter (o_custkey % 100 >= 5)::bigint as prompt_tokens, sum(o_orderkey % 7 - 1) filter (o_orderkey % 7 >= 1)::bigint as completion_tokens from orders) select *, prompt_tokens + completion_tokens as total_tokens from u")
def token_usage(spark, d):
    return metrics.token_usage(testbed.sessions(spark, d))


@query("select p_partkey, case when p_size % 7 = 0 then -1 else p_size end::int as p_size from part union all select -1 - o_orderkey, 0 from orders")
def upsert_rows(spark, d):
    old = testbed.table(spark, d, "part").select("p_partkey", "p_size")
    fresh = testbed.table(spark, d, "orders").selectExpr("-1 - o_orderkey as p_partkey", "0 as p_size")
    table = KeyedTable(spark, f"{shared_dir(spark)}/parley/keyed-{uuid.uuid4().hex}", "p_partkey", old.schema)
    table.create(old)
    table.upsert(old.where("p_size % 7 = 0").selectExpr("p_partkey", "-1 as p_size").unionByName(fresh))
    return table.read()


@query("select user_id, min(event_id) as ord, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def catalog_last_wins(spark, d):
    return last_wins(testbed.table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", c("event_id")).select("user_id", "ord", "event_type", "value")


# The turn loop


def _ran(spark, d):
    config = Config({"lexical": 1.0, "structured": 0.5}, 100, portfolio_ranking=True, explore_exploit=True, question_policy="eig")
    return engine.Engine(testbed.catalog(spark, d), config).run(testbed.samples(spark, d))


@query()
def evaluate_sessions(spark, d):
    """No SQL: ten dependent turns. Tested against a loop over sessions."""
    return _ran(spark, d)[0]


@query()
def session_transcript(spark, d):
    return _ran(spark, d)[1].drop("place")


@query()
def failure_report(spark, d):
    return report.failures(*_ran(spark, d), testbed.catalog(spark, d))
