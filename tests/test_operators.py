"""Ranking, fusion, re-ranking, state, metrics."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import dialog, fusion, lexical, metrics, structured, vectors
from parley.sources.catalog import upsert, upsert_markdown, with_features

c = F.col
CATALOG = "ord long, parent_asin string, title string, features array<string>, details map<string,string>, description array<string>, categories array<string>, store string, price_text string, price double"


def products(spark, rows):
    data = [(i, a, t, f, {}, [], [], s, None if p is None else str(p), p) for i, (a, t, f, p, s) in enumerate(rows)]
    return with_features(spark.createDataFrame(data, CATALOG)).withColumn("id", c("parent_asin"))


BELTS = [("A", "Black leather belt", [], 40.0, None), ("B", "Black leather wallet", [], 42.0, None), ("C", "Blue cotton shirt", [], 20.0, None), ("D", "Red silk scarf", [], 200.0, None)]


def test_lexical_best_first_and_blank(spark):
    docs = spark.createDataFrame([("A", "blue running shoe for men lightweight mesh"), ("B", "black leather winter boot waterproof"), ("C", "red cotton t-shirt crew neck")], "id string, text string")
    tokens = X.words(c("text"))
    queries = lexical.terms_of(spark.createDataFrame([(1, "blue running shoe"), (2, "  ")], "q long, text string"), "q", tokens)
    rows = lexical.search(lexical.postings(docs, "id", tokens), lexical.corpus_stats(docs, tokens), queries, 10).collect()
    assert [(r.query_id, r.id) for r in rows] == [(1, "A")]


def test_structured(spark):
    rows = [("A", "Black leather belt", ["leather"], 40.0, "Acme"), ("B", "Blue cotton shirt", ["cotton"], 200.0, "Other"), ("C", "Leather item", [], None, None)]
    asked = spark.createDataFrame([(1, "just looking around"), (2, "leather, budget around $50"), (3, "leather under $10 by acme"), (4, "leather $0")], "query_id long, text string")
    got = {}
    for r in structured.search(products(spark, rows), asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == {2: [("A", 1.5), ("C", 1.0)], 3: [("A", 1.5), ("C", 1.0)]}


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "query_id long, id string, rank int")
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(fusion.fuse([ranked("XYZ"), ranked("YXZ")], [2.0, 1.0]))[0] == "X"
    assert order(fusion.fuse([ranked("AB"), ranked("BA")], [1.0, 0.0])) == ["A", "B"]
    assert order(fusion.fuse([ranked("AB"), ranked("BA")], [1.0, 1.0])) == ["A", "B"]
    with pytest.raises(ValueError):
        fusion.fuse([ranked("A")], [1.0, 1.0])


def test_vectors_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = vectors.search(rows, rows.where("id < 7").select(c("id").alias("query_id"), "v"), 5, vectors.cells(rows, block=3)).collect()
    for q in range(7):
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == list(np.argsort(-(x @ x[q]), kind="stable")[:5])


def plain_cover(ids, values, counts, weight, k):
    if not ids:
        return []
    most, picked, left = max(counts.values(), default=0) or 1, [ids[0]], ids[1:]
    seen = set(values[ids[0]])
    while len(picked) < k and left:
        score = lambda i: (1 / (i + 1)) * (1 - weight) + weight * len(set(values[left[i]]) - seen) - 0.3 * (sum(counts.get(v, 0) for v in values[left[i]]) / most)  # noqa: B023, E731
        best = max(range(len(left)), key=lambda i: (score(i), -i))
        picked.append(left.pop(best))
        seen |= set(values[picked[-1]])
    return picked


def test_cover_matches_a_plain_loop(spark):
    rng = random.Random(5)
    words, rows, want = list("pqrstu"), [], {}
    for q in range(40):
        n, counts = rng.choice([0, 1, 3, 40, 120]), {w: rng.randint(1, 9) for w in rng.sample(words, rng.randint(0, 4))}
        values = {f"i{k}": sorted(rng.sample(words, rng.randint(0, 3))) for k in range(n)}
        want[q] = plain_cover(list(values), values, counts, 0.35, 10)
        rows += [(q, k + 1, i, v, counts) for k, (i, v) in enumerate(values.items())]
    df = spark.createDataFrame(rows, "query_id long, rank int, id string, values array<string>, counts map<string,int>")
    lists = fusion.prune_pool(df, 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "values"))).alias("pool"), F.first("counts").alias("counts"))
    got = {r.query_id: r.ids for r in lists.select("query_id", fusion.cover(c("pool"), c("counts"), F.lit(0.35), 10).alias("ids")).collect()}
    assert got == {q: v for q, v in want.items() if v}


def test_cover_diversifies(spark):
    pool = products(spark, BELTS).select(F.lit(1).alias("g"), (c("ord") + 1).alias("rank"), "id", "values")
    lists = pool.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "values"))).alias("pool"))
    run = lambda counts, k: lists.select(fusion.cover(c("pool"), counts, fusion.diversity_weight(F.lit(1), True), k).alias("x")).first().x
    none = F.create_map().cast("map<string,int>")
    assert set(run(none, 3)) == {"A", "C", "D"} and run(none, 3)[0] == "A" and run(none, 1) == ["A"]
    assert run(F.create_map(F.lit("leather"), F.lit(10)), 2)[1] != "B"


def test_normalize(spark):
    items = spark.createDataFrame([(1, i, x) for i, x in enumerate(["A", "bad", "A", " B ", "", "C"])], "query_id long, pos int, id string")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    assert [r.id for r in fusion.normalize(items, known).orderBy("rank").collect()] == ["A", "B", "C"]


def test_rerank_falls_back_and_repairs(spark):
    asked = spark.createDataFrame([("k1", ["A", "B"]), ("k2", ["A", "B", "C"]), ("k3", [])], "key string, ids array<string>")
    memo = spark.createDataFrame([("k1", ["B", "A"], 42, 7)], "key string, ranked array<string>, prompt_tokens long, completion_tokens long")
    rows = {r.key: r for r in fusion.rerank(asked, memo).collect()}
    assert rows["k1"].ranked == ["B", "A"] and rows["k1"].prompt_tokens == 42
    assert rows["k2"].ranked is None and rows["k2"].prompt_tokens == 0 and rows["k3"].ranked is None
    scorer = lambda df: df.select("key", F.array(F.lit("C"), F.lit("x")).alias("ranked"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens"))
    assert {r.key: r.ranked for r in fusion.rerank(asked, memo, scorer).collect()}["k2"] == ["C", "A", "B"]


def test_slots(spark):
    said = [(1, 1, "polyester"), (1, 2, "actually leather, and black"), (1, 3, "leather"), (2, 1, "black under $50")]
    rows = {(r.session_id, r.turn): r for r in dialog.slot_turns(spark.createDataFrame(said, "session_id long, turn int, text string")).collect()}
    assert [rows[1, t].overridden for t in (1, 2, 3)] == [[], ["material"], []]
    assert (rows[1, 3].material, rows[1, 3].color) == ("leather", "black") and (rows[2, 1].color, rows[2, 1].budget) == ("black", 50.0)


def test_queries_from_messages(spark):
    run = lambda m, t: spark.range(1).select(dialog.build_query(F.array(*map(F.lit, m)).cast("array<string>"), F.array(*map(F.lit, t)).cast("array<string>")).alias("q")).first().q
    assert run(["one", "two"], []) == "two two one" and run([], ["x"]) == "" and run(["one"], ["eco", "wide"]) == "one one eco wide"


def test_questions(spark):
    pool = products(spark, [("A", "Leather belt", [], 40.0, None), ("B", "Leather belt", [], 45.0, None), ("C", "Cotton shirt", [], 20.0, None), ("D", "Silk scarf", [], 200.0, None)])
    pool = pool.select(F.lit(1).alias("session_id"), (c("ord") + 1).alias("rank"), "material", "color", "size", c("bucket").alias("budget"))
    ask = lambda filled: dialog.choose_attribute(pool, spark.createDataFrame([(1, filled)], "session_id int, filled array<string>")).first().attribute
    assert ask([]) == "material" and ask(["material"]) == "budget" and ask(["material", "color", "size", "budget"]) == "style"
    assert ask(["material", "color", "size", "budget", "style", "use_case", "feature", "other"]) is None


def test_rejections(spark):
    p = products(spark, BELTS[:1])
    got = {r.value: r.n for r in dialog.rejection_counts(spark.createDataFrame([(1, "A")], "session_id long, id string"), p).collect()}
    assert got == {"leather": 1, "black": 1, "mid": 1}


def test_metrics(spark):
    rows = spark.createDataFrame([("a", True, 0.5, 2, True), ("b", False, 0.0, None, True)], "scenario_type string, hit boolean, reciprocal_rank double, first_hit_turn int, recall_hit boolean")
    r = metrics.metric_summary(rows).first()
    assert (r.sample_count, r.hit_rate_at_10, r.mrr, r.mttc) == (2, 0.5, 0.25, 6.5)
    record = metrics.metric_record(rows)
    assert record["efficiency"] == 0.45 and record["recommended_technical_score"] == 0.415 and set(record["scenario_metrics"]) == {"a", "b"}
    assert metrics.metric_record(rows.where("false"))["mttc"] is None
    probe = metrics.recall_probe(rows).first()
    assert (probe.miss_count, probe.ranking_failure_count, probe.retrieval_failure_fraction_of_misses) == (1, 1, 0.0)


def test_upserts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [(1, "a"), (2, "c")]
    head = ("| H |", "|---|")
    once = upsert_markdown("# T\n", head, "| x | 1 |", "x")
    assert once == "# T\n\n| H |\n|---|\n| x | 1 |\n"
    assert upsert_markdown(once, head, "| x | 2 |", "x") == "# T\n\n| H |\n|---|\n| x | 2 |\n"
    assert upsert_markdown(once + "\ntail\n", head, "| y | 2 |", "y").splitlines()[4:6] == ["| x | 1 |", "| y | 2 |"]
