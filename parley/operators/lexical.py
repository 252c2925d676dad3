"""Lexical ranking: BM25 over postings, plain and by weighted fields. Postings are DataFrames.

There are two searches. `search` joins query terms with postings on the term and sums scores by (query, id); it serves
few queries over postings as they are. `top_k` reads an index whose documents are dealt into parts and whose postings of a
term in a part are rows of BLOCK postings, best first, each with its greatest impact. A task holds one part and a
block of queries, so a common term is as many tasks as there are parts, nothing is shuffled by term, and no row is made
for a pair of query and document but the k best of each part.

An eighth of the parts is searched first. The k-th score there is a bar for the rest: blocks whose greatest impacts add
up to less than the bar are not scored; only documents that what was scored leaves able to reach the bar look up their
postings in them. The rows are those of a full scoring.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.staging import bounded, scratch, written


@dataclass(frozen=True)
class Bm25:
    """k1, b and the idf form: lucene is ln(1 + (N - df + .5) / (df + .5)), robertson drops the 1 and is 1e-6 at least."""

    k1: float = 1.5
    b: float = 0.75
    idf: str = "lucene"

    def idf_of(self, n: Column, df: Column) -> Column:
        ratio = (n - df + 0.5) / (df + 0.5)
        return F.log(1 + ratio) if self.idf == "lucene" else F.greatest(F.log(ratio), F.lit(1e-6))

    def gain(self, tf: Column, length: Column, mean: Column) -> Column:
        return tf / (tf + self.k1 * (1 - self.b + self.b * length / mean))


PLAIN, FIELDED = Bm25(), Bm25(k1=1.2, idf="robertson")


def postings(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """id, term, tf, dl: one row for each term of a document. dl counts all its tokens."""
    each = docs.select(F.col(id_col).alias("id"), tokens.alias("t")).select("id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("id", "term", "dl").agg(F.count("*").cast("double").alias("tf"))


def field_postings(docs: DataFrame, id_col: str, fields: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """As postings, with tf weighted by the field of each occurrence. fields: name to (tokens, weight)."""
    parts = F.array(*(F.struct(F.lit(float(w)).alias("w"), tokens.alias("t")) for tokens, w in fields.values()))
    each = docs.select(F.col(id_col).alias("id"), parts.alias("p")).withColumn("dl", F.aggregate("p", F.lit(0), lambda a, p: a + F.size(p.t)).cast("long"))
    flat = each.select("id", "dl", F.explode("p").alias("p")).select("id", "dl", F.col("p.w").alias("w"), F.explode("p.t").alias("term"))
    return flat.groupBy("id", "term", "dl").agg(F.sum("w").alias("tf"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents and mean tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("mean"))


def stats_of(posted: DataFrame, n: int) -> DataFrame:
    """As corpus_stats, from plain postings of n documents: their frequencies add up to the tokens."""
    return posted.agg(F.lit(n).cast("long").alias("n"), (F.coalesce(F.sum("tf"), F.lit(0.0)) / max(n, 1)).alias("mean"))


def search(posted: DataFrame, stats: DataFrame, queries: DataFrame, k: int, form: Bm25 = PLAIN, order: Column | None = None) -> DataFrame:
    """query_id, id, score, rank. queries: query_id, term (a term asked twice counts twice). Ties go to the lesser id.

    Document frequencies are counted over the asked terms alone; stats is a single row.
    """
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    hits = posted.join(queries.select("term").distinct(), "term", "left_semi")
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = frequency.join(F.broadcast(stats)).select("term", "mean", form.idf_of(F.col("n"), F.col("df")).alias("idf"))
    scored = hits.join(weights, "term").select("term", "id", (F.col("idf") * form.gain(F.col("tf"), F.col("dl"), F.col("mean"))).alias("s"))
    total = scored.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("s") * F.col("times")).alias("score")).where("score > 0")
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), order if order is not None else F.col("id"))
    return total.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def terms_of(queries: DataFrame, query_id: str, tokens: Column) -> DataFrame:
    """query_id, term of each query; blank queries give none."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens).alias("term"))


def plain_words(column: str) -> Column:
    return X.words(F.col(column))


#: Postings of a block, documents of a part, terms of the queries that meet a part at a time.
BLOCK, PART, TERMS = 64, 8192, 65_536
#: The share of parts that are searched first, as one in so many.
FIRST = 8
#: Scores are compared with the bar at this distance, as they are ranked at nine places.
NEAR = 1e-7


@dataclass(frozen=True)
class Index:
    """blocks: part, term, top, ids, gains (of falling gain), written down; of n documents in `parts` parts."""

    blocks: DataFrame
    n: int
    parts: int
    form: Bm25


def index(posted: DataFrame, stats: DataFrame, form: Bm25 = PLAIN, terms: DataFrame | None = None, part_docs: int = PART, block: int = BLOCK) -> Index:
    """posted: id, term, tf, dl; stats: as corpus_stats gives it; terms: only those of this table are kept.

    Few documents are dealt into as many parts as keep all cores busy, of 512 documents at least.
    """
    n, mean = stats.select("n", "mean").first()
    parts = max(1, -(-n // part_docs), min(8 * posted.sparkSession.sparkContext.defaultParallelism, n // 512))
    with scratch():
        kept = posted if terms is None else posted.join(bounded(written(terms.select("term").distinct(), "terms"), 40), "term", "left_semi")
        gained = kept.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "term", F.struct(form.gain(F.col("tf"), F.col("dl"), F.lit(float(mean or 1))).alias("gain"), "id").alias("p"))
        whole = gained.groupBy("part", "term").agg(F.sort_array(F.collect_list("p"), asc=False).alias("p"))
        starts = F.sequence(F.lit(1), F.size("p"), F.lit(block))
        cut = whole.select("part", "term", F.explode(F.transform(starts, lambda i: F.slice("p", i, F.lit(block)))).alias("p"))
        blocks = written(cut.select("part", "term", F.col("p")[0].gain.alias("top"), F.col("p.id").alias("ids"), F.col("p.gain").alias("gains")), "blocks", lasting=True)
    return Index(blocks, n, parts, form)


def _best_of_part(blocks: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The k best of a part for each query, with the numbers of blocks that it scored and that it met.

    The blocks of a term lie together by falling top, so what a query leaves out of a term is one run at its end.
    """
    blocks = blocks.take(pc.sort_indices(blocks, sort_keys=[("term", "ascending"), ("top", "descending")]))
    flat = blocks["ids"].combine_chunks().flatten().dictionary_encode()
    codes, names = flat.indices.to_numpy(), flat.dictionary
    place = np.empty(len(names), np.int64)
    place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
    gains = blocks["gains"].combine_chunks().flatten().to_numpy()
    tops, ends = blocks["top"].to_numpy(), np.cumsum(pc.list_value_length(blocks["ids"]).to_numpy())
    terms = blocks["term"].to_pylist()
    cuts = [i for i in range(len(terms) + 1) if i in (0, len(terms)) or terms[i] != terms[i - 1]]
    held = {terms[i]: (i, j, int(ends[i - 1]) if i else 0, int(ends[j - 1])) for i, j in zip(cuts, cuts[1:], strict=False)}
    filled: dict[str, np.ndarray] = {}  # the gains of terms that most documents have, one for each document

    def whole(term: str, begin: int, end: int) -> np.ndarray:
        if term not in filled:
            filled[term] = np.zeros(len(names))
            filled[term][codes[begin:end]] = gains[begin:end]
        return filled[term]

    queries: dict[object, tuple[float, list[tuple[str, float]]]] = {}
    for row in asked["asked"].to_pylist():
        for t in row:
            if t["term"] in held:
                queries.setdefault(t["query_id"], (t["bar"], []))[1].append((t["term"], t["weight"]))
    out = []
    for query_id, (bar, own) in queries.items():
        own.sort()
        met = sum(held[term][1] - held[term][0] for term, _ in own)
        left, most, n = [0] * len(own), 0.0, 0
        if bar > NEAR:
            bounds = [w * tops[held[term][0] : held[term][1]][::-1] for term, w in own]
            rises = np.concatenate([np.diff(x, prepend=0.0) for x in bounds])
            order = np.argsort(np.concatenate(bounds), kind="stable")
            so_far = np.cumsum(rises[order])
            n = int(np.searchsorted(so_far, bar - NEAR))
            if n:
                most = float(so_far[n - 1])
                left = np.bincount(np.repeat(np.arange(len(own)), [len(x) for x in bounds])[order[:n]], minlength=len(own)).tolist()
        total, rest, runs = np.zeros(len(names)), None, []
        for (term, w), less in zip(own, left, strict=True):
            i, j, begin, end = held[term]
            stop = end if not less else begin if less == j - i else int(ends[j - less - 1])
            if less:
                rest = np.full(len(names), most) if rest is None else rest
                rest[codes[begin:stop]] -= w * tops[j - less]
                runs.append((w, stop, end))
            if stop == end and 2 * (end - begin) > len(names):
                total += w * whole(term, begin, end)
            else:
                total[codes[begin:stop]] += w * gains[begin:stop]
        reach = total if rest is None else total + rest
        found = np.flatnonzero((total > 0) & (reach >= bar - NEAR))
        if len(found) > k:
            bar = max(bar, np.partition(total[found], -k)[-k])
            found = found[reach[found] >= bar - NEAR]
        if len(found) and runs:
            able = np.zeros(len(names), bool)
            able[found] = True
            for w, stop, end in runs:
                some = able[codes[stop:end]]
                total[codes[stop:end][some]] += w * gains[stop:end][some]
        found = found[np.lexsort((place[found], -np.round(total[found], 9)))[:k]]
        out.append((query_id, met - n, met, found, total[found]))
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[3]) for x in out)]), pa.int32()), names.take(pa.array(np.concatenate([x[3] for x in out]) if out else [], pa.int64())))
    scores = pa.ListArray.from_arrays(ids.offsets, pa.array(np.concatenate([x[4] for x in out]) if out else [], pa.float64()))
    return pa.table([pa.array([x[0] for x in out], asked["asked"].type.value_type.field("query_id").type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), ids, scores], ["query_id", "scored", "met", "ids", "scores"])


def _searched(made: Index, parts: Column, asked: DataFrame, k: int, blocks_of_queries: int) -> DataFrame:
    """What the parts found: query_id, scored, met, ids, scores. asked: query_id, term, weight, bar, b."""
    asked = written(asked, "asked")
    needed = bounded(written(asked.select("b", "term").distinct(), "needed"), 48)
    rows = made.blocks.where(parts).join(needed, "term").select("b", "part", "term", "top", "ids", "gains")
    packed = asked.groupBy("b").agg(F.collect_list(F.struct("query_id", "term", "weight", "bar")).alias("asked"))
    dealt = packed.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(made.parts - 1).cast("long"))).alias("part"), "asked").where(parts)
    q, i = asked.schema["query_id"].dataType.simpleString(), made.blocks.schema["ids"].dataType.elementType.simpleString()

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_of_part(left, right, k)

    # few bytes are much work here, so tasks are given by number and not left to be merged by size
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks_of_queries * made.parts)
    rows, dealt = (x.repartition(tasks, "b", "part") for x in (rows, dealt))
    return written(rows.groupBy("b", "part").cogroup(dealt.groupBy("b", "part")).applyInArrow(best, f"query_id {q}, scored long, met long, ids array<{i}>, scores array<double>"), "found")


def parts_found(made: Index, queries: DataFrame, k: int) -> DataFrame:
    """What each part found for each query, the first ones without a bar: query_id, scored, met, ids, scores."""
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    df = made.blocks.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    weighed = written(asked.join(df, "term").select("query_id", "term", (F.col("times") * made.form.idf_of(F.lit(made.n), F.col("df"))).alias("weight")), "weights")
    n = max(1, -(-weighed.count() // TERMS))
    weighed = weighed.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    first = F.col("part") < math.ceil(made.parts / FIRST)
    seen = _searched(made, first, weighed.withColumn("bar", F.lit(0.0)), k, n)
    if made.parts == 1:
        return seen
    each = seen.select("query_id", F.explode("scores").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bars = each.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).select("query_id", F.col("score").alias("bar"))
    barred = weighed.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    return seen.unionByName(_searched(made, ~first, barred, k, n))


def top_k(made: Index, queries: DataFrame, k: int) -> DataFrame:
    """As search, over an index: query_id, id, score, rank. Ties go to the lesser id."""
    flat = parts_found(made, queries, k).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", F.col("f.ids").alias("id"), F.col("f.scores").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return flat.where("score > 0").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
