"""Main text of web pages by a site style tree: the DOMs of a host merged, low-importance branches removed.

1. A tolerant parser gives each page's blocks (runs of text between block-level tags), each with its style node: the
   path of block-level elements with their classes, siblings alike merged. Elements whose role alone says that they are
   not the article (navigation, forms, scripts, adverts, notices, comments and so on) are passed over.
2. The pages of a host are merged: for each style node how many pages have it, how its children are laid out there
   (presentation) and which texts its blocks hold (content). Counts are summed before the shuffle, so a host with a
   third of all pages is only a few sums. Pages that are copies of one another count once: a page's sign is one of its
   blocks, drawn by a hash in proportion to length, so two pages have the same sign as often as they share text.
3. Importance is the information that a part carries about the page, from the entropy over signs. A text that c of the
   m signs of its node show carries log2((m + PRIOR) / c) bits; with less than one bit, shown by more than half, it
   is removed. A style node combines the entropy of its layouts with that of its contents and of its children, weighted
   by 0.9 for each layout; branches under `least_importance` are removed. PRIOR stands for pages not seen, so a few
   pages alike are no evidence; otherwise hosts of two pages and of millions are treated alike.

Entropy cannot tell an advert that no other page shows from the article, nor a menu that differs from page to page, so
element roles decide there, as in 1. If a page has `article` or `main` elements, its text is theirs.

Defined cases: a null html is an empty page with an empty text; a null or odd url has no host, so its page is judged by
roles alone; repeated rows are pages each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNFINISHED = re.compile(r"<[/!?a-zA-Z][^>]*\Z")
#: Element names of HTML by kind.
BLOCKS = frozenset("html body article section main div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 hgroup blockquote pre table caption thead tbody tfoot tr td th figure figcaption header footer nav aside form fieldset address details summary center hr menu dialog search".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav footer aside form head script style noscript iframe template button select textarea svg math canvas object audio video dialog menu search".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
SCOPE = frozenset("article section main div ul ol dl table td th blockquote nav aside footer header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Class and id names by which sites mark what is not the article, alone or as a part of a longer name.
ALONE = frozenset("nav navbar navigation menu sidebar footer header masthead banner ad ads share sharing social related recommended comments respond toolbar pager pagination".split())
PART = frozenset("advert advertisement advertisements adsense adslot cookie cookies consent gdpr popup modal overlay disqus breadcrumb breadcrumbs newsletter subscribe signup login sidebar sponsored".split())
ARTICLE = frozenset(("article", "main"))
FREE = frozenset(("html", "body", "article", "main"))
PRIOR = 2
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _is_noise(tag: str, a: dict[str, str], in_article: bool) -> bool:
    if tag in OUT or tag == "header" and not in_article:
        return True
    if not a or tag in FREE:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if "none" in a.get("style", "") and re.search(r"display\s*:\s*none", a["style"], re.I):
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    return any(n in ALONE or not PART.isdisjoint(re.split(r"[_-]", n)) for n in names)


class Page:
    """Blocks of a page: for each its text, style node, whether in an article, and its ancestors' nodes."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.layout: dict[int, list[int]] = {}  # node: its children's signatures in page order
        self.parents: dict[int, int] = {}
        stack: list[tuple[str, int, bool, bool]] = [("", 1, False, False)]  # tag, node, noise, in article
        text: list[str] = []

        def flush() -> None:
            if text:
                _, node, noise, inside = stack[-1]
                found = "" if noise else " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if found:
                    self.blocks.append((found, node, inside, tuple(x[1] for x in stack[1:])))

        def close(at: int) -> None:
            flush()
            del stack[at:]

        def find(names: tuple[str, ...], until: frozenset) -> int:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    return i
                if stack[i][0] in until:
                    break
            return 0

        at, end = 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            if not m:
                text.append(UNFINISHED.sub("", source[at:]))
                break
            if m.start() > at:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, raw = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if i := find((tag,), frozenset()):
                    if tag in BLOCKS or stack[i][2]:
                        close(i)
                elif tag == "p":
                    flush()
                continue
            if tag in RAW:
                if not raw.endswith("/"):
                    done = re.compile(f"</{tag}[^>]*>", re.I).search(source, at)
                    at = done.end() if done else end
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag not in BLOCKS and tag not in OUT:
                if tag not in VOID and not stack[-1][2] and "=" in raw and _is_noise(tag, _attributes(raw), stack[-1][3]):
                    flush()
                    stack.append((tag, stack[-1][1], True, stack[-1][3]))
                continue
            if tag in CLOSES_P and (i := find(("p",), SCOPE)):
                close(i)
            elif tag in SAME and (i := find(SAME[tag], frozenset(("ul", "ol", "dl", "table")) if tag not in ("dt", "dd") else frozenset(("dl",)))):
                close(i)
            flush()
            if tag in VOID:
                continue
            a = _attributes(raw)
            _, parent, noise, inside = stack[-1]
            inside = inside or tag in ARTICLE
            noise = noise or _is_noise(tag, a, inside)
            sign = xxhash.xxh3_64_intdigest(f"{tag}.{a.get('class', '')}#{re.sub(chr(92) + 'd+', '', a.get('id', ''))}")
            node = xxhash.xxh3_64_intdigest(b"%d/%d" % (parent, sign)) >> 1
            if not noise:
                seen = self.layout.setdefault(parent, [])
                if not seen or seen[-1] != sign:
                    seen.append(sign)
                self.parents[node] = parent
            stack.append((tag, node, noise, inside))
        flush()

    def chosen(self) -> list[tuple[str, int, bool, tuple[int, ...]]]:
        """The blocks of articles if there are any, else all."""
        inside = [b for b in self.blocks if b[2]]
        return inside or self.blocks

    def text(self, low_nodes: set[int], low_texts: set[tuple[int, int]]) -> str:
        blocks = self.chosen()
        if low_nodes or low_texts:
            blocks = [b for b in blocks if low_nodes.isdisjoint(b[3]) and (b[1], text_hash(b[0])) not in low_texts]
        return " ".join(b[0] for b in blocks)

    def sign(self) -> int:
        """The hash of one block: the least of exponential draws, that of a longer block being the lesser in proportion."""
        drawn = ((-math.log((h % (1 << 52) + 1) / (1 << 52)) / len(t), h) for t, h in ((b[0], text_hash(b[0])) for b in self.chosen()))
        return min(drawn, default=(0.0, 0))[1]


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def merged(pages: DataFrame) -> DataFrame:
    """host, node, parent, kind (0: layout, 1: text), feature (its hash), sign: one row for each that a page has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                sign = page.sign()
                out += [(host, node, page.parents.get(node, 0), 1, h, sign) for node, h in {(node, text_hash(t)) for t, node, _, _ in page.chosen()}]
                out += [(host, node, parent, 0, xxhash.xxh3_64_intdigest(repr(page.layout.get(node, ()))) >> 1, sign) for node, parent in page.parents.items()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "node", "parent", "kind", "feature", "sign"])

    return pages.mapInArrow(run, "host string, node long, parent long, kind int, feature long, sign long")


def importance(nodes: pd.DataFrame, least: float) -> list[int]:
    """Style nodes of one host whose composite importance is under least. Columns: node, parent, styles, layout, content."""
    by = {r.node: r for r in nodes.itertuples()}
    children: dict[int, list[int]] = {}
    for r in by.values():
        children.setdefault(r.parent, []).append(r.node)
    value: dict[int, float] = {}
    order = [n for n in by if by[n].parent not in by]
    for n in order:
        order += children.get(n, [])
    for n in reversed(order):
        r = by[n]
        below = [value[c] for c in children.get(n, ())] + ([r.content] if r.content == r.content else [])
        weight = 0.9 ** max(1, r.styles)
        value[n] = (1 - weight) * r.layout + weight * (sum(below) / len(below) if below else 1.0)
    return [n for n in order if value[n] < least]


def low_branches(pages: DataFrame, least: float) -> DataFrame:
    """host, nodes, texts: what to remove from the pages of a host."""
    c, m = F.col("c"), F.col("m") + PRIOR
    signs = merged(pages).distinct()
    counts = shared.stage(signs.groupBy("host", "node", "parent", "kind", "feature").agg(F.count("*").alias("c")), "style-tree")
    pages_of = counts.where("kind = 0").groupBy("host", "node", "parent").agg(F.sum("c").alias("m"), F.count("*").alias("styles"), F.sum(c * F.log(c)).alias("clogc"))
    pages_of = shared.stage(pages_of, "style-nodes")
    sized = shared.maybe_broadcast(pages_of.select(F.col("host").alias("h"), F.col("node").alias("n"), "m"), 80)
    known = counts.where("kind = 1").join(sized, F.expr("host = h and node = n")).drop("h", "n")
    texts = known.where(F.log2(m / c) < 1).groupBy("host").agg(F.collect_list(F.struct("node", "feature")).alias("texts"))
    # entropy of a node's contents over its signs, as a share of the most that there could be
    content = known.groupBy("host", "node").agg((1 - F.sum(c * F.log(c)) / F.sum("c") / F.log(F.max(m))).alias("content"))
    layout = F.log(F.col("m")) / F.log(m) - F.col("clogc") / F.col("m") / F.log(m)
    nodes = pages_of.withColumn("layout", layout).join(content, ["host", "node"], "left").select("host", "node", "parent", "styles", "layout", "content")

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        found = importance(rows, least)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "nodes": [np.array(found, np.int64)]}).iloc[: 1 if found else 0]

    low = nodes.groupBy("host").applyInPandas(judge, "host string, nodes array<long>")
    return texts.join(low, "host", "full_outer")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), least_importance: float = 0.1) -> DataFrame:
    """The columns keep and text."""
    host = F.nullif(F.lower(F.regexp_extract(F.col(f"`{url_col}`").cast("string"), HOST, 1)), F.lit(""))
    source = F.col(f"`{html_col}`").cast("string")
    low = shared.stage(low_branches(pages.select(host.alias("host"), source.alias("html")).where("host is not null"), least_importance), "low-branches")
    size = low.agg(F.sum(F.coalesce(F.size("texts"), F.lit(0)) * 32 + F.coalesce(F.size("nodes"), F.lit(0)) * 16 + 100)).first()[0] or 0
    places = len(keep)
    each = pages.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), host.alias("page_host"), source.alias("html"))
    joined = each.join(F.broadcast(low) if size <= 32 << 20 else low, F.expr("page_host = host"), "left").select(*(f"k{i}" for i in range(places)), "nodes", "texts", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found, memo = [], (None, None, set(), set())
                for nodes, texts, source in zip(*(part.column(c).to_pylist() for c in range(places, places + 3)), strict=True):
                    if memo[:2] != (nodes, texts):
                        memo = (nodes, texts, set(nodes or ()), {(t["node"], t["feature"]) for t in texts or ()})
                    found.append(Page(source or "").text(memo[2], memo[3]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(places)), pa.array(found, pa.string())], [*keep, "text"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return shared.map_rows(joined, run, f"{schema}, text string")
