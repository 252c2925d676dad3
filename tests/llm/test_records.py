"""WARC, HTML, chats and vectors against plain versions, with their edge cases."""

import io
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.llm import ann, chat, shared, site_tree, warc

PAGES = "page_id long, url string, html string, digest string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


def test_warc_round_trip(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdé<") for _ in range(100_000))
    rows = [(3, "http://a/ é", long), (1, "http://a/1", long), (2, None, None), (5, "u", ""), (6, "u", "<p>x</p>"), (6, "u", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "only"), (9, "q", "a\r\n\r\nb")]
    manifest = warc.write_warc(pages(spark, rows), shared.new_folder(spark, "w"), segment_bytes=3000, chunk_bytes=700, file_bytes=20_000)
    got = warc.read_warc(manifest).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    texts = [(str(i) if i is not None else None, h or "") for i, _, h in rows if (i, h) != (3, long) and not (i is None and h == "<p>x</p>") and i != 5]
    response = sorted(((r.key, r.payload.decode()) for r in got if r.record_type == "response"), key=str)
    assert response == sorted(texts, key=str)
    assert {(r.key, r.refers_to) for r in got if r.record_type == "revisit"} == {("3", "1"), (None, "6"), ("5", "2")}
    for r in got:
        wanted = {h or "" for i, _, h in rows if str(i) == str(r.key)}
        assert any(r.payload_digest == warc.base32_sha1(w.encode()) and r.payload_bytes == len(w.encode()) for w in wanted)
    assert warc.read_warc(warc.write_warc(pages(spark, []), shared.new_folder(spark, "w"))).count() == 0


def test_warc_faults():
    body = b"hello" * 1000
    framed = warc.chunked(body, 700)
    assert warc.unchunk(framed) == body and warc.unchunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (framed[:-400], b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunk(bad)
    parts = [(1, None, b"ab"), (3, 5, b"e"), (2, None, b"cd")]
    assert warc.join_segments(parts) == (b"abcde", None) and warc.join_segments(parts + parts[:1]) == (b"abcde", None)
    assert warc.join_segments(parts[:2])[1] == "a segment is missing" and warc.join_segments([parts[0], parts[2]])[1] == "the last segment is missing"
    assert warc.join_segments([(1, 9, b"ab")])[1] == "the total length differs"
    raw = b"".join(map(warc.member, warc.records_of(1, "u", body, None, None, "<urn:uuid:1>", 10**9, 700)))
    (head, block), = warc.parse(io.BytesIO(raw))
    assert warc.decode("response", block, head["warc-payload-digest"])[2] == body
    assert warc.decode("response", block, "sha1:OTHER")[3] == "the payload's digest differs"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(raw[:-30])))


ARTICLES = [
    ("<div class='ad'>x</div><p>Hi <b>bo<i>ld</b></i> t&amp;c<br>next<p>two<script>var a='<p>';</script> three", "Hi bold t&c next two three"),
    ("<article><header><h1>T</h1></header><p>a</p><section id=comments><p>c</p></section><form>f</form></article><footer>z", "T a"),
    ("<body><nav><ul><li>n</ul></nav><main><p>m &#233;&nbsp; x</p><aside>s</aside></main><div class='cookie-banner'>k</div>", "m é x"),
    ("plain 5 < 6 and 7 > 3 <foot", "plain 5 < 6 and 7 > 3"),
    ("<!-- x", ""),
    ("<ul><li>a<li>b</ul>c", "a b c"),
    ("<p>a<table><tr><td>1<td>2</table>d<span class=cookie-notice>n</span>e", "a 1 2 d e"),
    ("<p title=\"a>b\">q</p><style>p{}</style><textarea>t</textarea><P HIDDEN>h</P>", "q"),
]


@pytest.mark.parametrize(("html", "text"), ARTICLES)
def test_main_text(html, text):
    assert site_tree.Page(html).text(set(), set()) == text


def test_site_tree_removes_what_a_site_repeats(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    own = {i: " ".join(word() for _ in range(30)) for i in range(40)}
    rows = [(i, f"http://Site.example/{i}", f"<body><div class=top><p>Welcome to our site</p></div><div class=x><p>{t}</p><p>All rights kept</p></div></body>") for i, t in own.items()]
    rows += [(100, "http://site.example/copy", rows[7][2]), (101, "http://small.example/", "<div><p>Welcome to our site</p></div>"), (102, None, None), (103, "odd url", "<p>z"), (101, "http://small.example/", "<p>again")]
    got = site_tree.extract(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {(r.page_id, r.text) for r in got}
    assert found == {(i, t) for i, t in own.items()} | {(100, own[7]), (101, "Welcome to our site"), (101, "again"), (102, ""), (103, "z")}
    same = [(i, f"http://s.example/{i}", "<div><p>one text that all pages of a site have</p></div>") for i in range(12)]
    assert {r.text for r in site_tree.extract(pages(spark, same)).collect()} == {"one text that all pages of a site have"}
    notice = "This notice is longer than any article of the site and stands on each of its pages. " * 4
    short = [(i, f"http://n.example/{i}", f"<div><p>{notice}</p><p>{' '.join(word() for _ in range(8))}</p></div>") for i in range(60)]
    assert sum("notice" not in r.text and len(r.text.split()) == 8 for r in site_tree.extract(pages(spark, short)).collect()) == 60
    assert site_tree.extract(pages(spark, [])).count() == 0


def plain_tree(rows, least=0.1):
    """The texts that the site tree leaves, by dictionaries of one host each."""
    hosts = {}
    for i, (_, url, html) in enumerate(rows):
        hosts.setdefault((url or "").split("/")[2].lower() if "//" in (url or "") else None, []).append((i, site_tree.Page(html or "")))
    out = {}
    for host, found in hosts.items():
        signs, layouts, parent = {}, {}, {}
        for _, page in found:
            for text, node, _, _ in page.chosen():
                signs.setdefault((node, text), set()).add(page.sign())
            for node, up in page.parents.items():
                parent[node] = up
                layouts.setdefault(node, {}).setdefault(tuple(page.layout.get(node, ())), set()).add(page.sign())
        m = {n: sum(map(len, x.values())) for n, x in layouts.items()}
        value = {}

        def worth(n):
            each = [len(x) for (k, _), x in signs.items() if k == n]
            below = [worth(c) for c, up in parent.items() if up == n]
            most = math.log(m[n] + site_tree.PRIOR)
            if each:
                below.append(1 - sum(c * math.log(c) for c in each) / sum(each) / most)
            styles = [len(x) for x in layouts[n].values()]
            told = math.log(m[n]) / most - sum(c * math.log(c) for c in styles) / m[n] / most
            weight = 0.9 ** len(styles)
            value[n] = (1 - weight) * told + weight * (sum(below) / len(below) if below else 1.0)
            return value[n]

        for n in parent:
            if parent[n] not in parent:
                worth(n)
        for i, page in found:
            gone = host is not None
            out[i] = " ".join(t for t, n, _, up in page.chosen() if not gone or not (n in m and 2 * len(signs[n, t]) > m[n] + site_tree.PRIOR) and not any(value[x] < least for x in up if x in value))
    return [out[i] for i in range(len(rows))]


def test_site_tree_is_the_plain_one(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows = []
    for host, n in (("a.example", 2), ("b.example", 3), ("c.example", 7), ("d.example", 8), ("e.example", 40)):
        fixed = [" ".join(word() for _ in range(6)) for _ in range(6)]
        for k in range(n):
            own = [f"<p>{' '.join(word() for _ in range(rng.randint(5, 30)))}</p>" for _ in range(rng.randint(1, 5))]
            shown = [f"<div class=t{j}><p>{x}</p></div>" for j, x in enumerate(fixed) if rng.random() < (j + 1) / 6]
            rows.append((len(rows), f"http://{host}/{k}", f"<body>{''.join(shown)}<div>{''.join(own)}</div></body>"))
            if rng.random() < 0.2:
                rows.append((len(rows), f"http://{host}/{k}/copy", rows[-1][2]))
    rows += [(len(rows), None, "<p>x</p>"), (len(rows) + 1, "http://e.example/empty", None)]
    got = {r.page_id: r.text for r in site_tree.extract(pages(spark, rows)).collect()}
    want = plain_tree(rows)
    assert [got[i] for i in range(len(rows))] == want
    roles = [site_tree.Page(h or "").text(set(), set()) for _, _, h in rows]
    changed = {r[1].split("/")[2] for r, x, y in zip(rows, roles, want, strict=True) if x != y}
    assert {"c.example", "d.example", "e.example"} <= changed


def test_titles_inside_an_article_stay():
    for name in ("entry-header", "post-header", "share-price", "related-work", "header-title"):
        assert site_tree.Page(f"<article><div class='{name}'><h1>Title</h1></div><p>body</p></article>").text(set(), set()) == "Title body"


def test_columns_may_have_any_name(spark):
    rows = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "h", "n", "t", 2)], "page_id long, url string, html string, host string, nodes string, texts string, `a.b` int")
    assert site_tree.extract(rows, keep=("page_id", "host", "nodes", "texts", "a.b")).first()[:] == (1, "h", "n", "t", 2, "x")


def test_chats_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "&amp; &lt; & &eos; &nl;", "", None, "日本 <s>", "a\nb", "<<s>s>", "&", "<|im_start|>" * 3]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y"), (None, 1, "odd\nrole<s>", "z")]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, written string")
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chat.canonical_turns(turns))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r[2], r[3] or "") for r in rows[: len(texts)]]
    assert back[1].loss_text == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert [(t.role, t.text) for t in back[2].turns] == [("", "x"), ("assistant", "y"), ("assistant", "y")] and back[2].loss_text == "yy"
    assert [(t.role, t.text) for t in back[None].turns] == [("odd\nrole<s>", "z")]
    assert chat.read_chats(chat.format_chats(chat.canonical_turns(turns.where("false")))).count() == 0


def test_layouts(spark):
    said = lambda df: sorted(map(tuple, chat.canonical_turns(df).collect()))
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    two = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert said(frame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")) == two
    assert said(frame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from:string,value:string>>")) == two
    assert said(frame([(1, "q", None, "a")], "id long, instruction string, input string, output string")) == two
    assert said(frame([(1, "q", "a", "more")], "id long, prompt string, completion string, extra string")) == two
    with pytest.raises(ValueError):
        chat.mapping_for(frame([(1,)], "z long").schema)
    layouts = {m: frame([], k).schema for m, k in {"a": "id long, prompt string, completion string", "b": "id long, instruction string, output string"}.items()}
    raw = frame([('{"id": 1, "prompt": "q", "completion": "a"}',), ('{"output": "b", "id": 2, "instruction": "p"}',), ('{"x": 1}',), (None,)], "j string")
    assert sorted(map(tuple, chat.canonical_json(raw, "j", layouts).collect())) == two + [(2, 0, "user", "p"), (2, 1, "assistant", "b")]
    assert chat.unmatched_json(raw, "j", layouts).count() == 2


def test_nested_paths_choose_the_layout(spark):
    kinds = {"messages": "conv_id long, messages array<struct<role:string,content:string>>", "instruction": "id long, instruction string, output string", "input": "id long, instruction string, input string, output string"}
    layouts = {m: spark.createDataFrame([], k).schema for m, k in kinds.items()}
    rows = [
        '{"conv_id": 1, "messages": [{"content": "q", "role": "user"}, {"role": "assistant", "content": "a"}]}',
        '{"conv_id": 2, "messages": [{"from": "user", "value": "q"}]}',  # the same keys above, other paths below
        '{"id": 3, "instruction": "p", "output": "b", "score": {"x": 1}}',  # further fields
        '{"id": 4, "instruction": "p", "input": "i", "output": "b", "a.b": [1]}',
        '{"conv_id": 5, "messages": []}', "[1]", "no json", "", None,
    ]
    raw = spark.createDataFrame([(r, "l") for r in rows], "`j s` string, layout string")
    assert sorted(map(tuple, chat.canonical_json(raw, "j s", layouts).collect())) == [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (3, 0, "user", "p"), (3, 1, "assistant", "b"), (4, 0, "user", "p\n\ni"), (4, 1, "assistant", "b")]
    assert chat.unmatched_json(raw, "j s", layouts).count() == 6


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[1000:1400] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9000, [None] + [1.0] * 15, 0), (9004, [], 0), (9005, [1.0] * 3, 0), (None, x[0].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")
    got = {}
    for r in ann.search(table, F.col("id") % 50 == 0, block=300).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    assert set(got) == set(range(0, 1500, 50))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(score, 10)))[:5]
        assert list(found) == sorted(found) or set(found) == {1, 2, 3, 4, 5}
        hits += len({i for i, _ in found.values()} & set(best.tolist()))
        assert all(abs(s - unit[i] @ unit[q]) < 1e-9 for i, s in found.values())
    assert hits >= 0.95 * 5 * len(got)
    assert [got[1000][k][0] for k in range(1, 6)] == [7, 1001, 1002, 1003, 1004]
    assert ann.search(table.where("false"), F.col("id") % 50 == 0).count() == 0
    few = ann.search(table.where("vec_id in (0, 1, 2)"), F.col("id") == 0).orderBy("rank").collect()
    assert sorted(r.id for r in few) == [1, 2]


def test_each_dimension_is_searched(spark):
    rng = np.random.default_rng(21)
    x = {d: rng.normal(size=(n, d)).astype("f4") for d, n in ((3, 1), (5, 9), (8, 40))}
    rows = [(100 * d + i, v.tolist()) for d in x for i, v in enumerate(x[d])]
    want = {}
    for d, v in x.items():
        unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
        score = unit @ unit.T
        np.fill_diagonal(score, -9)
        want |= {100 * d + i: [100 * d + int(j) for j in np.argsort(-score[i])[: min(5, len(v) - 1)]] for i in range(len(v)) if len(v) > 1}
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), F.lit(True)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert set(got) == set(want) and all(len(got[q]) == 5 and {i // 100 for i in got[q]} == {q // 100} for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_codes_prune_what_is_compared(spark):
    """On 50,000 vectors with a third of them near one point: recall, and few exact comparisons a query."""
    rng = np.random.default_rng(22)
    x = rng.normal(size=(50_000, 16)).astype("f4")
    x[30_000:46_000] = x[3] + rng.normal(size=(16_000, 16)) * 0.3
    table = spark.createDataFrame(pd.DataFrame({"id": np.arange(50_000), "v": [v.astype(float).tolist() for v in x]}))
    sound = shared.stage(table, "vectors")
    model = ann.fit(sound)
    assert len(model.coarse) == math.isqrt(50_000)
    found = ann.best_of_blocks(sound, F.col("id") % 500 == 0, 5, 200, 4000, model).toPandas()
    each = found.groupby("query_id")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, rows in each:
        score = unit @ unit[q]
        score[q] = -9
        hits += len(set(rows.sort_values("score").id.tail(5)) & set(np.argsort(-score, kind="stable")[:5].tolist()))
    assert len(each) == 100 and hits >= 0.9 * 500
    assert each.compared.sum().max() < 25_000  # of each block's count this adds up to five times as much


def test_vectors_of_extreme_size_are_searched_like_others(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(260, 8))
    x[200:] *= np.repeat([1e-200, 1e200, 1e-310, 1e150, 1.0, 1e-150], 10)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [1e-320] * 8), (301, [1e200] * 8), (302, [1e308, -1e308] * 4), (303, [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1e300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.array([c / max(map(abs, e)) for c in e]) for i, e in rows}
    v = {i: e / np.linalg.norm(e) for i, e in v.items()}
    got = {}
    for r in ann.search(table, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    asked = [i for i in v if i % 20 == 0]
    assert set(got) == set(asked) and all(len(found) == 5 for found in got.values())
    hits = 0
    for q in asked:
        for _, i, score in got[q]:
            assert abs(score - v[q] @ v[i]) < 1e-9
        hits += len(set(sorted((i for i in v if i != q), key=lambda i: (-(v[q] @ v[i]), i))[:5]) & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 5 * len(asked)
