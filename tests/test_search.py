"""Structured and dense search and names in texts against plain loops, and how much of the data they read."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import vocabulary as V
from parley.operators import names, structured, vectors

c = F.col


def plain_structured(products, queries, k):
    out = {}
    for q, text in queries:
        words = [w for w in (*V.MATERIALS, *V.COLORS) if w in text.lower()]
        found = re.search(V.BUDGET_AMOUNT, text)
        budget = float(found[1]) if found else None
        if not words and budget is None or budget == 0:
            continue
        scored = []
        for i, (title, store, price) in enumerate(products):
            score = sum(w in title for w in words) + (1.0 if store and store in text.lower() else 0.0)
            if budget is not None and price is not None:
                score += 0.5 if price <= budget else -0.5 * min((price - budget) / budget, 1.0)
            if score > 0:
                scored.append((-score, i))
        out[q] = [(i, round(-s, 6)) for s, i in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


def product_table(spark, rows):
    data = [(f"p{i}", i, title, store, price) for i, (title, store, price) in enumerate(rows)]
    return spark.createDataFrame(data, "id string, ord long, match_text string, store_text string, price double")


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 400, 5), (2, 400, 40), (3, 30, 10)])
def test_structured_is_that_of_a_loop(spark, seed, n, k):
    rng = random.Random(seed)
    words = ["leather", "wool", "red", "tan", "navy", "plain", "thing"]
    price = lambda: rng.choice([None, 0.0, 9.99, 10.0, 10.001, 19.98, 20.0, 25.5, 300_000.0, 400_000.0, round(rng.uniform(1, 60), 2)])
    rows = [(" ".join(rng.sample(words, rng.randint(1, 4))), rng.choice(["", "acme", "ac", "northvale"]), price()) for _ in range(n)]
    said = ["just looking", "leather", "red wool thing under $10", "RED tan from Acme $19.98", "under $25.5", "navy northvale", "nothing $200000 leather", "wool $0.5", "acme red $0", "suede $12"]
    queries = list(enumerate(said))
    got = {}
    for r in structured.search(product_table(spark, rows), spark.createDataFrame(queries, "query_id long, text string"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((int(r.id[1:]), round(r.score, 6)))
    assert got == plain_structured(rows, queries, k)


def test_structured_reads_few_products_and_has_no_nested_loop(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(" ".join(rng.sample(["leather", "red", "plain"], rng.randint(1, 3))), "acme", round(rng.uniform(1, 500), 2)) for _ in range(5000)]
    kept, own = {}, structured.written
    monkeypatch.setattr(structured, "written", lambda df, name: kept.setdefault(name, own(df, name)))
    found = structured.search(product_table(spark, rows), spark.createDataFrame([(1, "red leather under $250")], "query_id long, text string"), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 10 and "NestedLoop" not in plan and "Cartesian" not in plan
    read = kept["segments"].join(kept["listed"], structured.LIST).where("most >= 2.5").select("key", "id").distinct().count()
    assert 10 <= read < 250


def test_nodes_hold_each_leaf_once(spark):
    rng = random.Random(5)
    ends = [(0, 0), (0, structured.LAST + 1), (5, 6), (0, 16), (1, 4096), (structured.LAST, structured.LAST + 1)] + [tuple(sorted((rng.randrange(100_000), rng.randrange(100_000)))) for _ in range(40)]
    rows = spark.createDataFrame([(i, None, a, b) for i, (a, b) in enumerate(ends)], "q long, level int, low long, high long")
    held = {}
    for r in structured.nodes_in(rows).collect():
        held.setdefault(r.q, []).append((r.node * 16**r.level, (r.node + 1) * 16**r.level))
    for i, (a, b) in enumerate(ends):
        own = sorted(held.get(i, []))
        assert [x for x, _ in own[1:]] == [y for _, y in own[:-1]] and len(own) <= 2 * 15 * 6
        assert (own[0][0], own[-1][1]) == (a, b) if a < b else not own


def test_names_are_those_that_texts_contain(spark):
    known = ["a", "ab", "abc", "bc", "", None, "naïve", "日本", "日", "😀x", *(f"brand {i}" for i in range(300)), "brand"]
    texts = [(1, "xabcx"), (2, "BC"), (3, None), (4, ""), (5, "brand 12 and brand 299"), (6, "naïve 日本 😀x"), (7, "bran"), (8, "brand 7" * 2000)]
    got = names.names_in(spark.createDataFrame(texts, "query_id long, low string"), spark.createDataFrame([(x,) for x in known + known], "store_text string"), part_names=70)
    want = sorted((i, n) for i, t in texts for n in {n for n in known if n and t and n in t})
    assert sorted(map(tuple, got.collect())) == want
    assert names.names_in(spark.createDataFrame(texts, "query_id long, low string"), spark.createDataFrame([], "store_text string")).count() == 0


def test_hot_beginnings_are_dealt_evenly(spark):
    known = spark.createDataFrame([(f"the same beginning {i}",) for i in range(2000)], "store_text string")
    texts = spark.createDataFrame([(i, f"say the same beginning {i % 2500}.") for i in range(3000)], "query_id long, low string")
    found = names.names_in(texts, known, part_names=500)
    assert found.count() == sum(len({str(i % 2500)[:n] for n in range(1, 5)} & {str(j) for j in range(2000)}) for i in range(3000))
    sizes = [r["n"] for r in found.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count_distinct("query_id").alias("n")).collect()]
    assert max(sizes) < 2 * min(sizes)


def best(x, q, k):
    return [(int(i), round(float(x[i] @ q), 6)) for i in np.lexsort((np.arange(len(x)), -np.round(x @ q, 9)))[:k]]


@pytest.mark.parametrize(("seed", "k", "more"), [(1, 5, {}), (2, 40, {"pivots": 3, "rings": 2, "block": 7}), (3, 500, {"block": 50}), (4, 1, {"rings": 1})])
def test_dense_is_exact_for_vectors_of_any_length(spark, seed, k, more):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 8)) * rng.choice([0.0, 0.01, 1, 50], size=(300, 1))
    x[200:220] = x[5]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    asked = np.concatenate([x[:9], -x[5:7], np.zeros((1, 8))])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, v array<double>")
    got = {}
    for r in vectors.search(rows, queries, k, vectors.cells(rows, **more)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    assert got == {i: best(x, q, k) for i, q in enumerate(asked)}


def test_dense_reads_few_cells_of_clustered_rows(spark):
    rng = np.random.default_rng(6)
    center = rng.normal(size=(40, 16))
    x = center[rng.integers(40, size=4000)] + 0.1 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    queries = rows.where("id < 50").select(c("id").alias("query_id"), "v")
    made = vectors.cells(rows, block=100)
    first = vectors.reads(made, queries, 10)
    found = {r.query_id: r.s for r in vectors.search(rows, queries, 10, made).groupBy("query_id").agg(F.min("score").alias("s")).collect()}
    barred = queries.join(spark.createDataFrame(list(found.items()), "query_id long, bar double"), "query_id").select("query_id", "v", "bar")
    read = first.unionByName(vectors.reads(made, barred, 10))
    assert read.groupBy("query_id", "cell", "block").count().where("count > 1").count() == 0
    assert read.count() < 0.2 * 50 * made.outline.blocks.sum()
    assert made.rows.count() == 4000 == made.outline.n.sum() and made.rows.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 200


def test_dense_of_no_rows(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert vectors.search(none, none.withColumnRenamed("id", "query_id"), 3).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    assert vectors.search(some, none.withColumnRenamed("id", "query_id"), 3).count() == 0
    assert vectors.search(none, some.withColumnRenamed("id", "query_id"), 3).count() == 0
