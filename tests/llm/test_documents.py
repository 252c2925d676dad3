"""Operators on documents against brute force, with their edge cases, and the pipeline."""

import functools
import itertools
import random
import struct
import sys
import tracemalloc
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import block_pairs, components, lines, ngram_join, packing, pieces, quality, setbits, shared, token_store, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, __row string, comp string, __stats string, __lines int, bands int, `a.b` string"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 7, "x", "y", "z", 1, 2, "dot") for i, t, lang, src in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, near copies, one long text without spaces."""
    rng = random.Random(1)
    rows = []
    for i in range(12):
        base = [prose(rng, 12) for _ in range(10)]
        rows.append((i, "\n".join(base), "en", "a"))
        near = list(base)
        near[i % 10] = near[i % 10] + " zz"
        rows.append((100 + i, "\n".join(near), "en", "a"))
    rows += [(200, None, "en", "a"), (201, "", None, None), (None, prose(rng, 80), "de", None), (None, prose(rng, 80), "de", None), (3, rows[6][1], "en", "a"), (3, rows[6][1], "en", "a")]
    rows += [(202, "word " * 400, "en", "a"), (203, "x" * 300_000, "fr", "b"), (204, " \n\t\n ", "fr", "b"), (205, "日本 語   é\r\n" * 30, "ja", "b")]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).coalesce(1)


def test_statistics_of_texts():
    def plain(text):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        windows = list(zip(words, words[1:], words[2:], strict=False))
        hit = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
        full = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(full), len(full) - len(set(full)), len(hit)

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\t#é\x0b ") for _ in range(rng.randint(0, 60)))
        assert quality.text_statistics(text) == plain(text), text


def test_quality_keeps_the_clean_and_rejects_outliers(spark, none):
    rng = random.Random(3)
    rows = [(i, "\n".join(prose(rng, 20) for _ in range(6)), "en" if i % 2 else "de", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng, 120).split()), "en", "s") for i in range(40)] + [(2000, "short", "en", "s"), (2001, "a b c " * 100, "en", "s"), (2002, None, "en", None)]
    kept = quality.keep_good(table(spark, rows))
    assert kept.columns == table(spark, []).columns and {r.doc_id for r in kept.collect()} == set(range(300))
    assert quality.keep_good(none).count() == 0


def test_mcd_finds_the_bulk_despite_a_third_of_outliers(spark):
    rng = np.random.default_rng(4)
    bulk, far = rng.normal([1, 0, 0, 0], 0.05, (700, 4)), rng.normal([3, 1, 1, 1], 0.05, (300, 4))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in np.concatenate([bulk, far])], "grp string, x0 double, x1 double, x2 double, x3 double")
    center = quality.fit(rows).first().center
    assert np.abs(np.array(center) - bulk.mean(0)).max() < 0.02


def test_small_groups_have_estimates_of_their_own(spark):
    """A group of 30 rows far from its language: its rows stay, and a row like those of the rest goes there."""
    rng = random.Random(18)
    long = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(11, 13))) for _ in range(15)) for _ in range(6))
    rows = [(i, "\n".join(prose(rng, 15) for _ in range(6)), "en", "plain") for i in range(400)]
    rows += [(1000 + i, long(), "en", "long") for i in range(30)] + [(2000, long(), "en", "plain")]
    kept = {r.doc_id for r in quality.keep_good(table(spark, rows)).collect()}
    assert kept >= set(range(400)) and kept >= set(range(1000, 1030)) and 2000 not in kept


def test_groups_lean_on_their_parents_by_their_size():
    parent = {"n": 1000, "center": [1.0, 0, 0, 0], "scatter": np.eye(4).ravel().tolist()}
    centers = [quality.shrunk([{"n": n, "center": [3.0, 0, 0, 0], "scatter": np.eye(4).ravel().tolist()}, parent])[0][0] for n in (1, 2, 30, 99, 100, 101, 100_000)]
    assert centers == sorted(centers) and centers[0] < 1.2 and centers[-1] > 2.99 and centers[5] - centers[3] < 0.01


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_components(spark, limit):
    rng = random.Random(5)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)]
    want = roots(300, links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), limit=limit).collect()}
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}


def gram_set(text, n):
    words = (text or "").encode().translate(ngram_join.LOWER).split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_words_are_remembered_within_a_bound_of_bytes():
    """Vocabularies grow with the corpus and words may be of any length; what a worker remembers does not."""
    known = ngram_join.WordHashes()
    words = [b"%d" % i for i in range(150_000)] + [b"%d-" % i * 500 for i in range(2000)]
    assert [known[w] for w in words] == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert [known[w] for w in words[-2100:]] == [xxhash.xxh3_64_intdigest(w) for w in words[-2100:]]
    assert len(known) and sys.getsizeof(known) + sum(sys.getsizeof(w) + sys.getsizeof(h) for w, h in known.items()) < 12 << 20


def test_rows_of_large_batches_are_made_in_slices():
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(10_000), pa.int64()), "data": pa.array([b"%d" % (i % 10) * 2000 for i in range(10_000)], pa.binary())})
    tracemalloc.start()
    try:
        assert [row for row, data in shared.rows_of([batch, batch.slice(0, 0), batch.slice(9990)]) if data == b"%d" % (row % 10) * 2000] == [*range(10_000), *range(9990, 10_000)]
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_classes_against_all_pairs(spark, odd, none, n, percent):
    rng, rows = random.Random(6), []
    for g in range(12):
        base = prose(rng, rng.choice([2, 5, 20, 60])).split()
        for k in range(6):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((g * 10 + k, " ".join(own), "en", "a"))
    docs = table(spark, rows).unionByName(odd.where("doc_id is null or doc_id <> 203"))
    got = ngram_join.classes_of(docs, n=n, percent=percent).orderBy("row").collect()
    plain = [(r.doc_id, gram_set(r.text, n)) for r in docs.collect()]
    links = [(i, j) for (i, (_, x)), (j, (_, y)) in itertools.combinations(enumerate(plain), 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = roots(len(plain), links)
    least = {}
    for i, (doc, _) in enumerate(plain):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    want = sorted((str(d), len(s), str(least.get(root[i]))) for i, (d, s) in enumerate(plain))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert len({r.comp for r in got}) == len(set(root))
    kept = ngram_join.keep_one(docs, n=n, percent=percent)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert ngram_join.classes_of(none).count() == 0 and ngram_join.keep_one(none).count() == 0


@pytest.mark.parametrize("block", [3, 500])
def test_ngram_links_are_all_counted(spark, odd, none, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "count_links", functools.partial(block_pairs.count_links, block=block))
    rng, rows = random.Random(13), []
    for g, (size, times) in enumerate([(60, 14), (40, 6), (5, 4), (80, 3)]):
        base = prose(rng, size).split()
        for k in range(times):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((g * 100 + k, " ".join(own), "en", "a"))
    docs = table(spark, rows).unionByName(odd.where("doc_id is null or doc_id <> 203"))
    plain = [(r.doc_id, gram_set(r.text, 3)) for r in docs.collect()]
    want = sorted((str(d), sum(1 for j, (_, y) in enumerate(plain) if i != j and x and y and 100 * len(x & y) >= 80 * len(x | y))) for i, (d, x) in enumerate(plain))
    assert max(n for _, n in want) > 4 and any(n not in (0, 13) for _, n in want[:14])
    got = ngram_join.classes_of(docs, n=3, percent=80, links_col="n_links").collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == want
    assert ngram_join.classes_of(none, links_col="n_links").count() == 0


def test_intersections_by_slices():
    rng = np.random.default_rng(14)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(x, y)) for y in sets[10:]] for x in sets[:10]]
    assert block_pairs.intersections(sets[:10], sets[10:], width=16).tolist() == want


def test_prefix_tree_loses_no_link():
    rng = np.random.default_rng(7)
    for percent in (60, 80, 90) * 20:
        sets = []
        for _ in range(4):
            base = rng.integers(0, 400, rng.integers(1, 60))
            for _ in range(5):
                x = base.copy()
                m = rng.integers(0, max(1, len(x) // 8) + 1)
                x[rng.integers(0, len(x), m)] = rng.integers(0, 3000, m)
                sets.append(np.unique(x).astype(np.uint64))
        prefixes = [x[: ngram_join.prefix_length(len(x), percent)].tolist() for x in sets]
        held = rng.integers(1, 20)
        found = []
        for token in {t for p in prefixes for t in p}:
            tree = ngram_join.PrefixTree(percent)
            for i, p in enumerate(prefixes):
                if token in p:
                    k = p.index(token)
                    cut = p[k : k + 1 + held]
                    last = cut[-1] if k + 1 + held < len(p) else p[-1]
                    m = ngram_join.Member(i, len(sets[i]), i, p[:k], cut, list(range(k, k + len(cut))), last, setbits.parity(sets[i]))
                    found += [(e.row, i) for e in tree.search(m)]
                    tree.add(m)
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert want <= set(found) and len(found) == len(set(found))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(16)
    bits = lambda x: (8 * len(setbits.parity(x)), int.from_bytes(setbits.parity(x), "little"))
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 1 << 60, rng.integers(0, 700), dtype=np.uint64)) for _ in range(2))
        y = np.union1d(x[rng.random(len(x)) < 0.9], y[: rng.integers(0, 30)])
        assert setbits.differ(bits(x), bits(y)) <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("block", [4, 500])
def test_a_dense_group_gives_links_in_proportion_to_its_members(spark, block, monkeypatch):
    """Every member of a group shares most of its text with all others, few of them enough to be linked."""
    told = []
    for name in ("active", "tree_links"):
        def counted(*args, made=getattr(ngram_join, name), name=name):
            out = shared.stage(made(*args, block=block), "told")
            told.append((name, out.count()))
            return out
        monkeypatch.setattr(ngram_join, name, counted)
    rng = random.Random(17)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(len(own)), 4):
            own[at] = prose(rng, 1)
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.classes_of(docs, n=3, percent=85).collect()}
    sets = [gram_set(t, 3) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(60), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = roots(60, links)
    assert [got[i] for i in range(60)] == root and len(set(root)) > 1
    most = 60 * 60 // block if block < 60 else 60
    assert dict(told)["tree_links"] <= 3 * most and dict(told)["active"] <= 60 * 20


def test_line_dedup_against_all_pairs(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    places = [(d is None, d or 0, i, n, x) for i, (d, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if x.strip(lines.SPACE)]
    texts = sorted({p[4] for p in places})
    sets = [lines.shingle_set(x.encode()) for x in texts]
    root = roots(len(texts), [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if lines.alike(sets[i], sets[j], 80)])
    of = {x: root[i] for i, x in enumerate(texts)}
    first = {}
    for p in sorted(places):
        first.setdefault(of[p[4]], p)
    want = sorted(str(("\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(lines.SPACE) or first[of[x]][2:4] == (i, n))) if t is not None else None) for i, (d, t) in enumerate(rows))
    out = lines.dedup_lines(odd.coalesce(1), out="told")
    assert out.columns == [*odd.columns, "told"]
    assert sorted(str(r.text) for r in out.collect()) == want
    assert lines.dedup_lines(none, out="told").count() == 0


def test_short_lines_with_one_change_are_alike(spark):
    rng = random.Random(15)
    rows = []
    for i in range(20):
        line = prose(rng, 20)[:60].strip() + "x"
        rows += [(i, line, "en", "a"), (100 + i, line[:30] + "#" + line[31:], "en", "a")]
    told = {r.doc_id: r.told.removed for r in lines.dedup_lines(table(spark, rows), out="told").collect()}
    assert all(told[i] == 0 for i in range(20)) and sum(told.values()) >= 19


def test_a_pair_is_judged_alike_in_buckets_of_any_size(spark):
    """The same pair of lines, at the very threshold or just under it, alone in a bucket and among many."""
    rng = random.Random(19)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(104))
    grams = lambda x: lines.shingle_set(x.encode())
    pairs = {}
    for k in range(1, 40):
        other = base[: 104 - k] + "".join(rng.choice("qrstuvwxyz") for _ in range(k))
        pairs[k] = (other, lines.alike(grams(base), grams(other), 80))
    rows = [(k, i, x) for k, (other, _) in pairs.items() for i, x in enumerate((base, other))]
    payloads = lines.comparable(spark.createDataFrame([(10 * k + i, x) for k, i, x in rows], "row long, text string"))
    for fillers in (0, 5, 6, 7, 8, 30):
        noise = [(10_000 + i, "".join(rng.choice("ABCDEFGH") for _ in range(90))) for i in range(fillers)]
        data = payloads.unionByName(lines.comparable(spark.createDataFrame(noise or [(9, "x")], "row long, text string")))
        members = [(k, 10 * k + i, 10 * k + i) for k, i, _ in rows] + [(k, r, r) for k in pairs for r, _ in noise]
        got = lines.link_blocks(spark.createDataFrame(members, "token long, row long, comp long"), data, 80, False).collect()
        assert {r.a // 10 for r in got} == {k for k, (_, same) in pairs.items() if same} and len(got) == len({r.a // 10 for r in got})


def test_signatures_do_not_depend_on_neighbours():
    some = ["abc", "hello world this is", "x", "日本語のテキストです。テスト", "a" * 9, "a" * 8, "longer line number one two three"]
    signed = lambda x: lines.signatures(*lines.shingle_hashes(x, lines.SHINGLE))
    assert (signed(some) == np.concatenate([signed([x]) for x in some])).all()


def test_known_chunks_are_looked_up_once_beside_new_ones():
    class Counted(tokens.Memo):
        asked = 0

        def __getitem__(self, chunk):
            self.asked += 1
            return super().__getitem__(chunk)

    encoder = tokens.ChunkEncoder(BPE)
    encoder.memo = Counted()
    known = "a " + " ".join(f"known{i}" for i in range(200))
    encoder.encode([known])
    encoder.memo.asked = 0
    texts = [f"{known} first new\nsecond new", f"a new\nsecond {known} third"]
    found = encoder.encode(texts)
    assert found == [array("I", encoder.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert encoder.memo.asked < 2 * 200 + 30


def test_chunks_give_the_ids_of_the_whole_text():
    encoder = tokens.ChunkEncoder(BPE, memo_entries=50)
    texts = ["", " ", "  a", "a  b", "a \n b", "a\n b", "\n\n x", "x \n", "tab\t x", "x's don't  \n\n y", "<|endoftext|> a <|endoftext|>", "a 　b", "\x1c a", "a \x1cb \x85 c", "日本 語  x\n日本\nb's 12 c", "a\n\nb", "a\n", "\na"]
    rng = random.Random(8)
    texts += ["".join(rng.choice("ab1'. \n\té日") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for _ in range(2):
        assert encoder.encode(texts) == [array("I", encoder.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_added_tokens_are_those_of_the_library(tmp_path):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "a b<|endoftext|>\nc", "a <|endoftext| > b", "new york city", "york new x"] * 2
    spaced = Tokenizer.from_file(BPE)
    spaced.add_tokens(["new york"])
    spaced.save(str(tmp_path / "spaced.json"))
    for path in (BPE, str(tmp_path / "spaced.json")):
        fresh = Tokenizer.from_file(path)
        assert tokens.ChunkEncoder(path).encode(texts) == [array("I", fresh.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_token_store(spark, odd, none):
    manifest = token_store.write_store(odd, shared.new_folder(spark, "t"), BPE, shard_bytes=4000)
    rows = token_store.read_store(manifest).collect()
    encoder = tokens.ChunkEncoder(BPE)
    want = sorted((str(r.doc_id), (np.frombuffer(encoder.encode([r.text or ""])[0], "<u4").tolist() + [2])) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and ids[0] is None
    shard = token_store.ShardReader(manifest.orderBy("partition", "shard").first().path)
    assert shard.find(10**9) is None and (shard.ids(0) == rows[0].ids).all()
    digests = {r.start: r.ids_crc32 for r in token_store.read_store(manifest, digest=True).collect()}
    assert digests == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    assert token_store.read_store(token_store.write_store(none, shared.new_folder(spark, "t"), BPE)).count() == 0
    store, path = shared.filesystem(shard_path := manifest.first().path)
    token_store._dictionary.cache_clear()
    with store.open_output_stream(path.rsplit("/", 1)[0] + "/dictionary.zdict") as f:
        f.write(b"another")
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.ShardReader(shard_path)


def test_token_store_of_a_large_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer

    large, path = Tokenizer.from_file(BPE), str(tmp_path / "large.json")
    large.add_tokens([f"<x{i}>" for i in range(16_000)])
    large.save(path)
    docs = spark.createDataFrame([(1, "a <x15999> b"), (2, "plain text")], "doc_id long, text string")
    want = {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for i, t in docs.collect()}
    assert max(want[1]) >= 1 << 16
    assert {r.doc_id: r.ids for r in token_store.read_store(token_store.write_store(docs, shared.new_folder(spark, "t"), path)).collect()} == want
    with pytest.raises(ValueError, match="does not fit"):
        token_store._narrow(array("I", [1 << 16]).tobytes(), 2)


def test_dictionary_is_of_spans_from_anywhere(spark):
    docs = spark.createDataFrame([(i, "a " * 5000 + f"rare{i} " * 5000) for i in range(20)], "doc_id long, text string")
    ids = tokens.ChunkEncoder(BPE).tokenizer.encode(" rare").ids
    assert any(i.to_bytes(4, "little") in token_store.train_dictionary(docs, "doc_id", "text", BPE, 4, dict_bytes=1 << 26)[-(1 << 10) :] for i in ids)


def test_sizes_and_parities_of_many_lines_at_once():
    rng = random.Random(12)
    some = ["a", "ab", "abcde", "ab" * 3, "x" * 5000, "é日" * 700, prose(rng, 3000)] + [prose(rng, rng.randint(1, 60)) for _ in range(300)]
    h, starts, stops = lines.shingle_hashes(some, 5)
    keys = lines.distinct_shingles(h, starts, stops)
    heads, sizes = lines.heads_of(keys, len(some)), lines.sizes_of(keys, len(some))
    for a, b, head, size in zip(starts.tolist(), stops.tolist(), heads, sizes.tolist(), strict=True):
        grams = np.unique(h[a:b])
        bits = setbits.parity(grams)
        assert size == len(grams) and head == struct.pack("<IH", len(grams), 8 * len(bits)) + bits


def test_counts_of_shingles_by_one_sort():
    rng = random.Random(14)
    some = ["a", "abcd", "abcde", "ab" * 3, "x" * 5000, "é日" * 700, prose(rng, 3000)] + [prose(rng, rng.randint(1, 60)) for _ in range(490)] + ["zz"]
    hashed = lines.shingle_hashes(some, 5)
    assert lines.counted_shingles(*hashed).tolist() == [len(lines.shingle_set(x.encode())) for x in some]
    assert [lines.counted_shingles(*lines.shingle_hashes([x], 5)).tolist() for x in some[:5]] == [[1], [1], [1], [2], [1]]


def test_line_dedup_stages_no_bands(spark, monkeypatch):
    """Bands go from the texts to their tasks; of lines only places and nodes are written, those of words alone."""
    rng, staged, stage = random.Random(16), {}, shared.stage
    same = prose(rng, 30)
    rows = [(1, f"{same}\n \t\n{prose(rng, 20)}", "en", "a"), (2, f"\n{prose(rng, 20)}\n{same}", "en", "a"), (3, None, "en", "a"), (4, " \v\f\r\t", "en", "a")]

    def told(df, name):
        staged[name] = (df.columns, stage(df, name))
        return staged[name][1]

    monkeypatch.setattr(shared, "stage", told)
    monkeypatch.setattr(shared, "release", lambda *_: None)
    out = {r.doc_id: (r.text, r.told.lines, r.told.removed) for r in lines.dedup_lines(table(spark, rows), out="told").collect()}
    assert out[1] == (rows[0][1], 2, 0) and out[2] == (rows[1][1].removesuffix("\n" + same), 2, 1) and out[3] == (None, 0, 0) and out[4] == (rows[3][1], 0, 0)
    columns, written = staged["lines"]
    assert columns == ["__row", "__id", "line", "node"]
    assert sorted((r["__id"], r.line) for r in written.collect()) == [(1, 0), (1, 2), (2, 1), (2, 2)]


def test_buckets_of_equal_lines_are_one(spark):
    """Alike lines share many bands with nobody else; they meet once, and blocks are crossed only where a bucket has several."""
    rng = random.Random(18)
    groups = [[f"{base} {k}" for k in range(3)] for base in (prose(rng, 60) for _ in range(30))]
    docs = spark.createDataFrame([("\n".join(g),) for g in groups], "text string").repartition(3)
    met = {}
    for r in lines.shared_bands(docs, 90, 80).collect():
        met.setdefault(r.token, []).append(r.row)
    sets = [frozenset(x) for x in met.values()]
    assert sum(map(len, sets)) == sum(map(len, met.values())) and len(set(sets)) == len(sets)
    nodes = [sorted(r.row for r in spark.createDataFrame([(x,) for x in g], "text string").select(F.xxhash64("text").alias("row")).collect()) for g in groups]
    joined = [functools.reduce(frozenset.union, (x for x in sets if x & set(n)), frozenset()) for n in nodes]
    assert [sorted(x) for x in joined] == nodes

    members = spark.createDataFrame([(t, row, row) for t, x in met.items() for row in x], "token long, row long, comp long")
    texts = spark.createDataFrame([(x,) for g in groups for x in g], "text string")
    payloads = lines.comparable(texts.select(F.xxhash64("text").alias("row"), "text"))
    assert lines.link_blocks(members, payloads, 80, True) is None
    assert lines.link_blocks(members, payloads, 80, True, block=1) is not None


def test_names_of_sets_of_nodes():
    token, node = np.array([1, 1, 2, 2, 3, 3, 3], np.int64), np.array([5, 2**62, 2**62, 5, 5, 2**62, 2**62 + 1], np.int64)
    names = lines.set_names(token, node)
    assert names[0] == names[1] == names[2] == names[3] != names[4] == names[5] == names[6]
    assert len(lines.set_names(token[:0], node[:0])) == 0


def test_rows_of_shared_tokens():
    rng = np.random.default_rng(20)
    pairs = np.zeros(5000, lines.PAIR)
    pairs["token"], pairs["node"] = rng.integers(-(2**62), 2**62, 5000) << 1, np.arange(5000)
    pairs["token"][:40] = pairs["token"][100:140]
    pairs["token"][200:210] = pairs["token"][300:310] + (1 << 20)  # alike in the low bits alone
    of = {}
    for t, n in zip(pairs["token"].tolist(), pairs["node"].tolist(), strict=True):
        of.setdefault(t, []).append(n)
    want = sorted(n for x in of.values() if len(x) > 1 for n in x)
    assert sorted(lines.of_shared_tokens(pairs)["node"].tolist()) == want and len(want) == 80
    assert [len(lines.of_shared_tokens(pairs[:k])) for k in (0, 1, 2)] == [0, 0, 0]


def test_numbers_of_shingles_judge_as_their_sets():
    rng = random.Random(21)
    letters = {"narrow": "ab c", "accents": "é\x01ßa ", "cyrillic": "\u0430\u0431\u0432 \u0433", "edge": "\u0ffd\u0ffea", "wide": "\u65e5\u672c\u8a9e\u0fff ", "lone": "\ud800ab", "large": "\U0001f389ab"}
    some = ["a", "b", "abcd", "abcde", "aaaa", "aaaaa", "aaaaaa", "\x00", "\x00\x00", "\x00\x00\x00\x00\x00"]
    for own in letters.values():
        for n in (1, 4, 5, 6, 30, 80):
            base = "".join(rng.choice(own) for _ in range(n))
            some += [base, base[: n // 2] + "b" + base[n // 2 :], base + "a" * (n // 10), base[::-1]]
    data = sorted({x.encode("utf-8", "surrogatepass") for x in some})
    texts = [x.decode("utf-8", "surrogatepass") for x in data]
    heads = lines.heads_of(lines.distinct_shingles(*lines.shingle_hashes(texts, lines.SHINGLE)), len(texts))
    each, sets, told = [lines.Line(*x) for x in zip(heads, data, strict=True)], [lines.shingle_set(x) for x in data], set()
    for i, j in itertools.product(range(len(data)), repeat=2):
        same = lines.alike(sets[i], sets[j], 80)
        assert each[i].alike(each[j], 80) == same
        told.add((each[i].numbers is None, each[j].numbers is None, same, i == j))
    assert {(a, b, c, False) for a, b, c in [(False, False, True), (False, False, False), (True, True, True), (True, False, False)]} <= told
    assert all(x.numbers is None or len(x.numbers) == len(s) for x, s in zip(each, sets, strict=True))


def test_packing(spark, odd, none):
    rows = packing.pack(odd, BPE, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 64
    lengths = [len(tokens.ChunkEncoder(BPE).encode([r.text or ""])[0]) // 4 + 1 for r in odd.collect()]
    assert sorted(r.length for r in rows) == sorted(x for n in lengths for x in packing.cut_lengths(n, 64))
    assert len(by) <= sum(c for _, c in packing.best_fit(np.bincount([r.length for r in rows], minlength=65), 64)) + 1
    assert packing.pack(none, BPE).count() == 0


def test_plans_cover_the_histogram_near_the_bound():
    rng = np.random.default_rng(9)
    for n in (0, 1, 30, 3000, 60_000):
        lengths = np.minimum(rng.lognormal(5, 1, n).astype(int) + 1, 512)
        histogram = np.bincount(lengths, minlength=513)
        made, got = packing.plan(histogram, 512), np.zeros(513, int)
        for parts, times in made:
            assert sum(parts) <= 512
            for v in parts:
                got[v] += times
        assert (got[1:] == histogram[1:]).all()
        bound = max(-(-int(lengths.sum()) // 512), int((lengths > 256).sum())) if n else 0
        assert sum(c for _, c in made) <= bound * 1.02 + 2


@pytest.fixture(scope="module")
def bpe_model():
    return pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(bpe_model):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), random.Random(10)
    texts = ["", "a", "  a", " a b", "a  b   c", "hello world\n\tfoo", "汉字 🎉 é", "▁x", " ", " \n ", "ab" * 500, "<s></s><unk><0x0A>", "un" * 40 + " tail"]
    texts += ["".join(rng.choice("abehinorst  \n.é汉") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for text in texts:
        ids = bpe_model.encode(text).tolist()
        assert ids == library.encode(text), text
        assert bpe_model.decode(ids) == text.replace("▁", " ")
        marked = (" " + text).replace(" ", "▁")
        assert list(bpe_model._ids(bpe_model.stream(marked))) == ids or not text


def test_short_segments_are_held_whole(bpe_model, monkeypatch):
    """Words within the window take the search without commits, and give what the stream gives; ids decode by one table."""
    rng = random.Random(13)
    words = ["", "a", "é漢🎉", "\n", "<0x0A>", "x" * (4 * bpe_model.longest - 1), "the.\nAnd"]
    words += ["".join(rng.choice("abdehinorstuéß.\n#漢") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    want = [list(bpe_model.stream(pieces.MARK + x)) for x in words]
    assert [bpe_model._held(pieces.MARK + x) for x in words] == want
    with monkeypatch.context() as m:
        m.setattr(bpe_model, "stream", lambda text: pytest.fail("a short segment took the stream"))
        assert [bpe_model._segment(x) for x in words] == [bpe_model._ids(x).tobytes() for x in want]
    assert b"".join(bpe_model.raw[i] for i in bpe_model._ids(want[2])) == (pieces.MARK + words[2]).encode()


def test_one_stream_commits_in_a_bounded_window(spark, bpe_model):
    """On whole texts, long and short: ids as of the library, commits on the way, and a window that never grows."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text]
    texts += ["x" * 5000, "ab" * 3000, " ".join(texts)[:50_000].replace(" ", ""), "  " * 500 + "end", "é漢🎉" * 700]
    commits = 0
    for text in texts:
        seen = []
        ids = bpe_model.whole(text, lambda size, found: seen.append((size, found)))  # noqa: B023
        assert ids.tolist() == library.encode(text) == bpe_model.encode(text).tolist()
        assert max(size for size, _ in seen) <= 8 * bpe_model.longest
        assert len(text) < 8 * bpe_model.longest or len(seen) > 1 and all(found for _, found in seen[1:])
        commits += len(seen) - 1
    assert commits > 20 * len(texts)


def test_unigram_paths_score_no_less_than_the_library(tmp_path):
    import sentencepiece
    import sentencepiece.sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    path = tmp_path / "uni.model"
    path.write_bytes(proto.SerializeToString())
    own, library = pieces.PieceModel(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(11)
    for _ in range(200):
        text = "".join(rng.choice("abehinorst  .") for _ in range(rng.randint(1, 60)))
        score = lambda ids: sum(own.scores[i] for i in ids)
        assert score(own.encode(text)) >= score(library.encode(text)) - 1e-3


def test_piece_columns(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    short = odd.where("doc_id is null or doc_id <> 203")
    back = pieces.decode(pieces.encode(short, path), path)
    assert back.where("coalesce(text, '') <> decoded").count() == 0 and back.count() == short.count()
    assert pieces.digests(odd.select("doc_id", "text"), path).where("not round_trip").count() == 0
    assert pieces.encode(none, path).count() == 0


def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, "\n".join(prose(rng, 15) for _ in range(8)), "en", "s") for i in range(60)]
    rows += [(100, rows[5][1], "en", "s"), (101, rows[6][1].replace("a", "a", 1) + " tail", "en", "s"), (102, "short", "en", "s")]
    table(spark, rows).unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert set(range(12, 60)) <= ids and not ids & {100, 102, 200, 201, 202, 204}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert stage(spark, none, str(tmp_path)).count() == 0
