"""Upserts that rewrite few files, and an index that grows by segments."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators import lexical
from parley.operators import segments as G
from parley.sources.keyed import KeyedTable

c = F.col


def rows_of(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


def test_upsert_rewrites_only_the_files_that_hold_its_keys(spark, tmp_path):
    old = spark.createDataFrame([(2 * i, f"v{i}") for i in range(1000)] + [(None, "none")], "k long, v string")
    table = KeyedTable(spark, str(tmp_path / "t"), "k", old.schema)
    table.create(old, file_rows=101)
    files = table.versions.parts(1)
    assert 8 <= len(files) <= 10 and sum(f["n"] for f in files) == 1001
    new = spark.createDataFrame([(10, "x"), (14, "y"), (15, "z")], "k long, v string")
    assert table.upsert(new, 101) == (2, 1)
    want = {2 * i: f"v{i}" for i in range(1000)} | {None: "none", 10: "x", 14: "y", 15: "z"}
    assert rows_of(table) == sorted(want.items(), key=str) and len(rows_of(table, 1)) == 1001
    assert len({f["file"] for f in files} & {f["file"] for f in table.versions.parts(2)}) == len(files) - 1
    assert table.upsert(spark.createDataFrame([(2001, "odd"), (99_999, "far")], "k long, v string"), 101) == (3, 0)
    assert table.upsert(spark.createDataFrame([(501, "between"), (None, "other")], "k long, v string"), 101) == (4, 0)
    assert len(rows_of(table)) == 1001 + 5
    assert table.upsert(new.where("false"), 101)[1] == 0 and len(rows_of(table)) == 1006
    with pytest.raises(RuntimeError, match="there is a table"):
        table.create(old)


def test_upserts_of_two_writers_both_stay(spark, tmp_path, monkeypatch):
    old = spark.createDataFrame([(f"k{i:03d}", i) for i in range(100)], "k string, v int")
    one, two = (KeyedTable(spark, str(tmp_path / "t"), "k", old.schema) for _ in range(2))
    one.create(old, 20)
    own, late = one.touched, []

    def touched(files, keys):
        if not late:
            late.append(two.upsert(spark.createDataFrame([("k001", -2), ("k050", -2)], "k string, v int"), 20))
        return own(files, keys)

    monkeypatch.setattr(one, "touched", touched)
    assert one.upsert(spark.createDataFrame([("k001", -1), ("new", -1)], "k string, v int"), 20)[0] == 3 and late[0][0] == 2
    got = dict(rows_of(one))
    assert got["k001"] == -1 and got["k050"] == -2 and got["new"] == -1 and len(got) == 101


def texts(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(f"w{min(200, int(rng.paretovariate(0.7)))}" for _ in range(rng.randint(0, 30)))) for i in range(n)] + [(n, None)], "id long, text string")


def tokens():
    return X.words(c("text"))


def same(grown, docs):
    key = lambda df: sorted((r.id, r.term, r.dl, r.tf) for r in df.select("id", "term", "dl", "tf").collect())
    told, plain = grown.stats().first(), lexical.corpus_stats(docs, tokens()).first()
    assert key(grown.postings()) == key(lexical.postings(docs, "id", tokens()))
    assert told.n == plain.n and abs((told.mean or 0) - (plain.mean or 0)) < 1e-9


def test_an_index_of_parts_is_that_of_the_whole(spark, tmp_path):
    docs = texts(spark, 200)
    grown = G.Segments(spark, str(tmp_path / "g"))
    assert grown.postings().count() == 0 and grown.stats().first().n == 0
    for i in range(3):
        grown.add(docs.where(c("id") % 3 == i), "id", tokens())
    same(grown, docs)
    grown.delete(docs.where("id < 50 or id = 200").select("id").unionByName(spark.createDataFrame([(999,)], "id long")))
    same(grown, docs.where("id >= 50 and id <> 200"))
    changed = docs.where("id < 20").withColumn("text", F.concat("text", F.lit(" again again")))
    grown.add(changed, "id", tokens())
    live = docs.where("id >= 50 and id <> 200").unionByName(changed)
    same(grown, live)
    queries = lexical.terms_of(spark.createDataFrame([(1, "w3 w5 again"), (2, "w1")], "q long, text string"), "q", tokens())
    rows = lambda posted, stats: [tuple(r) for r in lexical.top_k(lexical.index(posted, stats), queries, 5).select("query_id", "rank", "id", F.round("score", 9)).orderBy("query_id", "rank").collect()]
    assert rows(grown.postings(), grown.stats()) == rows(lexical.postings(live, "id", tokens()), lexical.corpus_stats(live, tokens()))


def test_a_delta_reads_only_its_own_rows(spark, tmp_path, monkeypatch):
    docs = texts(spark, 60)
    grown = G.Segments(spark, str(tmp_path / "g"))
    grown.add(docs.where("id < 30"), "id", tokens())
    old = {v for s in grown.versions.parts(1) for v in (s["postings"], s["docs"])}
    read, seen = grown._read, []
    monkeypatch.setattr(grown, "_read", lambda names, schema: seen.extend(names) or read(names, schema))
    grown.add(docs.where("id >= 30"), "id", tokens())
    assert seen and not old & set(seen)
    assert old <= {v for s in grown.versions.parts(2) for v in (s["postings"], s["docs"])}


def test_segments_of_a_tier_are_merged(spark, tmp_path):
    docs = texts(spark, 100, 3)
    grown = G.Segments(spark, str(tmp_path / "g"))
    for i in range(9):
        grown.add(docs.where(c("id") % 9 == i), "id", tokens())
        if i == 4:
            grown.delete(docs.where("id % 9 <= 4 and id < 30").select("id"))
    parts = grown.versions.parts(grown.versions.latest())
    assert len(parts) <= 4 and sum(s["n"] for s in parts) == docs.where("not (id % 9 <= 4 and id < 30)").count()
    same(grown, docs.where("not (id % 9 <= 4 and id < 30)"))
