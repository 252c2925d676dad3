"""The registered queries themselves, on whole small tables, against plain versions."""

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from parley.llm import lines, queries, quality, site_tree

from test_documents import gram_set, roots
from test_records import plain_tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def asked(spark, name, folder=SF):
    return queries.QUERIES[name](spark, folder)


def test_op1_gives_the_ids_of_the_library(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes())) for d, ids in ((d, library.encode(t or "")) for d, t in zip(documents.doc_id, documents.text, strict=True))}
    got = asked(spark, "op1_sentencepiece").collect()
    assert {r.doc_id: (r.n_pieces, r.ids_crc32) for r in got} == want and all(r.round_trip for r in got)


def plain_mcd(x, support=0.6):
    """Exact concentration steps from the same starts; the regularised estimate of least determinant."""
    floor, found = np.diag(np.square(quality.FLOOR)), []
    quartiles = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    starts = [(quartiles[1], np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True).reshape(quality.DIM, -1) + floor)]
    h = math.ceil(support * len(x) - 1e-9)
    for center, scatter in starts:
        for _ in range(30):
            far = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
            near = x[np.argsort(far, kind="stable")[:h]]
            center, scatter = near.mean(0), quality.consistency(h / len(x)) * np.cov(near.T, bias=True).reshape(quality.DIM, -1) + floor
        found.append((np.linalg.det(scatter), center, scatter))
    return min(found, key=lambda f: f[0])[1:]


def plain_verdicts(frame):
    """doc_id: (base_failed, squared distance or None) by text_statistics and plain_mcd."""
    stats = [quality.text_statistics(t) for t in frame.text]
    rows, out = {}, {}
    for d, lang, source, (words, chars, symbols, n_lines, dup, repeat) in zip(frame.doc_id, frame.lang, frame.source, stats, strict=True):
        if words < 50 or 100 * repeat > 50 * words:
            out[d] = True, None
        else:
            rows[d] = (lang, source), np.array([math.log(chars / words), math.sqrt(symbols / chars), dup / n_lines, repeat / words])
    def fitted(prefix):
        some = np.array([x for g, x in rows.values() if g[: len(prefix)] == prefix])
        return len(some), *plain_mcd(some)
    known = {p: fitted(p) for p in {g[:k] for g, _ in rows.values() for k in (0, 1, 2)}}
    for d, (g, x) in rows.items():
        _, center, scatter = known[()]
        for k in (1, 2):
            n, own, around = known[g[:k]]
            w = n / (n + quality.PRIOR_ROWS)
            center, scatter = w * own + (1 - w) * center, w * around + (1 - w) * scatter
        out[d] = False, float((x - center) @ np.linalg.inv(scatter) @ (x - center))
    return out


def test_op3_verdicts_are_those_of_plain_estimates(spark):
    frame = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_verdicts(frame)
    got = {r.doc_id: r for r in asked(spark, "op3_quality", "/root/testdata/sf0.01").collect()}
    assert set(got) == set(want)
    near = 0
    for d, (failed, far) in want.items():
        assert got[d].base_failed == failed and (failed or abs(got[d].distance2 - far) <= 0.25 * far + 0.5)
        if not failed and abs(math.log((far + 1e-9) / quality.CUTOFF)) < 0.25:
            near += 1
        else:
            assert got[d].kept == (not failed and far <= quality.CUTOFF)
    assert near < 0.01 * len(want)


def test_op4_classes_and_links(spark, documents):
    sets = [gram_set(t, 3) for t in documents.text]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    root = roots(len(sets), links)
    least = {}
    for d, r in zip(documents.doc_id, root, strict=True):
        least[r] = min(d, least.get(r, d))
    told = np.bincount(np.array(links, int).ravel(), minlength=len(sets))
    want = {d: (len(s), least[r], n) for d, s, r, n in zip(documents.doc_id, sets, root, told.tolist(), strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in asked(spark, "op4_ngram_join").collect()} == {d: x[:2] for d, x in want.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in asked(spark, "op4_ngram_links").collect()} == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op5_recall(spark, sf):
    frame = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = frame.vec_id.to_numpy(), np.array(frame.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in asked(spark, "op5_ann", f"/root/testdata/{sf}").collect():
        found.setdefault(r.query_id, {})[r.rank] = r.vec_id, r.score
    hits = 0
    assert set(found) == set(ids[ids % 50 == 0].tolist())
    for q, got in found.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -9
        hits += len({v for v, _ in got.values()} & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
        assert sorted(got) == [1, 2, 3, 4, 5] and all(abs(s - score[ids == v][0]) < 1e-9 for v, s in got.values())
    assert hits >= 0.9 * 5 * len(found)


def test_op6_is_the_plain_tree(spark):
    frame = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    rows = list(zip(frame.page_id, frame.url, frame.html, strict=True))
    got = {r.page_id: r for r in asked(spark, "op6_site_tree", "/root/testdata/sf0.01").collect()}
    want = plain_tree(rows)
    assert {i: got[i].text for i, _, _ in rows} == {r[0]: t for r, t in zip(rows, want, strict=True)}
    assert all(r.n_chars == len(r.text) for r in got.values())
    # no article of these tables shares a block with half of its host, and their adverts and menus differ by page
    assert want == [site_tree.Page(h or "").text(set(), set()) for _, _, h in rows]


def test_op7_ids(spark, documents):
    from tokenizers import Tokenizer

    fresh, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for d, t in sorted(zip(documents.doc_id.tolist(), documents.text, strict=True)):
        ids = [*fresh.encode(t or "", add_special_tokens=False).ids, 2]
        want[d] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in asked(spark, "op7_token_store").collect()} == want


def test_op9_pieces_and_places(spark, documents):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = asked(spark, "op9_packing").toPandas()
    total = 0
    for d, t in zip(documents.doc_id.tolist(), documents.text, strict=True):
        ids = np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == d].sort_values("piece")
        total += len(ids)
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum()][:-1] and own.length.sum() == len(ids)
        assert len(own) == 1 if len(ids) <= 2048 else (own.length.iloc[1:] == 2048).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    sequences = 0
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()][:-1] and own.length.sum() <= 2048
        sequences += 1
    assert sequences <= math.ceil(total / 2048) * 1.02 + 1


def plain_lines(texts):
    """doc_id: its text without later near-alike lines and the number of its lines, by comparing all pairs."""
    places = sorted((d, n, x) for d, t in texts.items() for n, x in enumerate((t or "").split("\n")) if x.strip(lines.SPACE))
    each = sorted({x for _, _, x in places}, key=len)
    sets = [lines.shingle_set(x.encode()) for x in each]
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    by, links = [sets[i] for i in order], []
    for a, i in enumerate(order):
        end = np.searchsorted(size[order], size[i] * 100 // 80, "right")
        links += [(i, order[b]) for b in range(a + 1, end) if lines.alike(by[a], by[b], 80)]
    of, first = dict(zip(each, roots(len(each), links), strict=True)), {}
    for p in places:
        first.setdefault(of[p[2]], p)
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(lines.SPACE) or first[of[x]][:2] == (d, n)) for d, t in texts.items() if t is not None}


def test_op10_keeps_one_line_of_each_class(spark, documents):
    want = plain_lines(dict(zip(documents.doc_id, documents.text, strict=True)))
    got = {r.doc_id: r.text for r in asked(spark, "op10_line_dedup").collect()}
    differ = [d for d, t in want.items() if got[d] != t]
    assert len(differ) <= 0.01 * len(want)  # bands meet 0.994 of the pairs at 0.8


def test_pipeline_is_the_chain_of_plain_stages(spark, documents):
    from tokenizers import Tokenizer

    import corpus_pipeline

    verdicts = plain_verdicts(documents)
    good = documents[[not verdicts[d][0] and verdicts[d][1] <= quality.CUTOFF for d in documents.doc_id]]
    texts = dict(zip(good.doc_id.tolist(), good.text, strict=True))
    left = {d: t for d, t in plain_lines(texts).items() if any(x.strip(lines.SPACE) for x in t.split("\n"))}
    ids = sorted(left)
    sets = [gram_set(left[d], 5) for d in ids]
    links = [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    kept = [ids[r] for r in sorted(set(roots(len(ids), links)))]
    fresh, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for d in kept:
        tokens = np.array([*fresh.encode(left[d], add_special_tokens=False).ids, 0], "<u4")
        cuts = [len(tokens) % 2048 or 2048, *[2048] * ((len(tokens) - 1) // 2048)] if len(tokens) > 2048 else [len(tokens)]
        start = 0
        for k, n in enumerate(cuts):
            want.add((d, k, start, n, zlib.crc32(tokens[start : start + n].tobytes())))
            start += n
    rows = corpus_pipeline.run(spark, SF).toPandas()
    got = set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert len(want ^ got) <= 0.02 * len(want)  # bands meet 0.994 of the line pairs at 0.8; distances are binned
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()][:-1] and own.length.sum() <= 2048
