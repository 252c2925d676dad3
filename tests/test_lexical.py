"""The block index against a full scoring."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import lexical

c = F.col


def zipf(rng, n, words=400):
    return " ".join(f"w{min(words, int(rng.paretovariate(0.6)))}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(f"d{i:05d}", zipf(rng, rng.randint(1, 60))) for i in range(6000)]
    rows += [(f"e{i:03d}", rows[i % 5][1]) for i in range(300)] + [("none", None), ("empty", "")]
    return spark.createDataFrame(rows, "id string, text string").cache()


def built(docs, **more):
    tokens = X.words(c("text"))
    posted, stats = lexical.postings(docs, "id", tokens), lexical.corpus_stats(docs, tokens)
    return posted, stats, lexical.index(posted, stats, **more)


def ranks(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in df.collect())


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(8)
    rows = [(i, zipf(rng, rng.randint(1, 9))) for i in range(40)] + [(50, "w1 w1 w1 w2"), (51, "  "), (52, "nowhere"), (53, None), (54, "w1"), (55, "w300 w1 w2 w3")]
    return lexical.terms_of(spark.createDataFrame(rows, "q long, text string"), "q", X.words(c("text")))


@pytest.mark.parametrize(("k", "more"), [(10, {}), (1, {"block": 8, "part_docs": 700}), (500, {"part_docs": 1500}), (7, {"form": lexical.FIELDED, "part_docs": 10_000})])
def test_blocks_give_the_rows_of_a_full_scoring(spark, docs, queries, k, more):
    posted, stats, made = built(docs, **more)
    want = ranks(lexical.search(posted, stats, queries, k, made.form))
    assert len(want) > 40 and ranks(lexical.top_k(made, queries, k)) == want


def test_only_asked_terms_are_kept(spark, docs, queries):
    posted, stats, made = built(docs, terms=queries)
    assert made.blocks.join(queries, "term", "left_anti").count() == 0
    assert ranks(lexical.top_k(made, queries, 5)) == ranks(lexical.search(posted, stats, queries, 5))


def test_under_half_of_the_blocks_are_scored(spark, docs, queries):
    made = built(docs, part_docs=400)[2]
    seen = lexical.parts_found(made, queries, 3).agg(F.sum("scored"), F.sum("met")).first()
    assert seen[1] > 1000 and seen[0] < 0.5 * seen[1]


def test_no_task_holds_a_whole_term(spark, docs, queries):
    made = built(docs, part_docs=400)[2]
    term = made.blocks.where("term = 'w1'").groupBy("part").agg(F.sum(F.size("ids")).alias("n"), F.max(F.size("ids")).alias("most"))
    rows = term.collect()
    assert len(rows) == made.parts > 10 and max(r.n for r in rows) <= 500 and max(r.most for r in rows) == lexical.BLOCK
    tops = made.blocks.select(F.col("top") == F.array_max("gains"), F.element_at("gains", -1) >= 0).distinct().collect()
    assert [tuple(t) for t in tops] == [(True, True)]


def test_empty_index_and_no_queries(spark, docs, queries):
    made = built(docs.where("false"))[2]
    assert lexical.top_k(made, queries, 5).count() == 0
    assert lexical.top_k(built(docs)[2], queries.where("false"), 5).count() == 0
