"""Similarity join of documents on word n-grams by prefix trees, exact, with the components of its links.

A document's set is its distinct word n-grams, ordered by one global order: by the rarest word in each, as a counting
sketch of the words of the whole corpus has it (an n-gram is no more frequent than its rarest word; the sketch has a
fixed size, so the order costs one pass and at most a few MB for each task). Two sets of Jaccard similarity t or more share an n-gram among the first |x| - ceil(t |x|) + 1 of each.

1. Equal sets are put together; one document stands for each.
2. Prefix n-grams that two or more documents share make buckets. Every document is first compared with one pivot of
   its buckets, the member that shares most of its prefix with others; two rounds of this find nearly all components,
   at a cost in proportion to the documents and not to the pairs of a group. Prefixes alone rule most pairs out;
   whole sets are made for the rest.
3. In buckets that still hold several components, all remaining pairs are covered: prefixes are stored in a trie,
   traversed with shared partial overlaps, and subtrees are pruned by the bound on the overlap that the remaining
   lengths allow. What survives is verified on the whole sets. Large buckets are dealt out as pairs of blocks.

So every pair of linked documents is verified or already connected; the classes are exact. n-grams are compared by
hashes of 56 bits and more.

4. The number of links of each document, where asked for: linked sets are of one class, so all pairs of distinct sets
within each class are compared, by matrix products of blocks, and copies are counted as often as they occur.

Defined cases: documents without words (or with a null text) have an empty set and stand alone; with fewer than n
words the whole sequence is the one n-gram; repeated rows and repeated ids are rows of their own; a null id counts for
no component's least id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .block_pairs import count_links
from .components import components
from .pairs import by_pivot, verify
from .setbits import allowed, differ, needed, parity

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLOT_BITS, CHUNKS = 20, 64
LOW, SHIFT = np.uint64((1 << 56) - 1), np.uint64(64 - SLOT_BITS)


class WordHashes(dict):
    """Hashes of words, remembered up to a bound of bytes: a few thousand words make most of a text, long ones recur little."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _words() -> WordHashes:
    return WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))


def sketch(docs: DataFrame, text_col: str) -> np.ndarray:
    """For each slot of word hashes, the class of its count of documents' words (four classes for each doubling)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                parts = [np.unique(word_hashes(t)) for t in batch.column(0).slice(i, 256).to_pylist()]
                total += np.bincount((np.concatenate(parts) >> SHIFT).astype(np.int64), minlength=len(total))
        if total.any():
            each = np.split(total, CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(x.astype("<u4").tobytes(), 1) for x in each], pa.binary())], ["chunk", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "classes": [np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8).tobytes()]})

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "chunk int, counts binary")
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in counted.groupBy("chunk").applyInPandas(add, "chunk int, classes binary").collect():
        out[r.chunk * len(out) // CHUNKS : (r.chunk + 1) * len(out) // CHUNKS] = np.frombuffer(r.classes, np.uint8)
    return out


def ordered_set(text: str | None, n: int, classes: np.ndarray) -> np.ndarray:
    """The distinct n-grams as numbers whose order is the global one."""
    w = word_hashes(text)
    if not len(w):
        return w
    rare = classes[(w >> SHIFT).astype(np.int64)]
    k = min(n, len(w))
    size = len(w) - k + 1
    h, rarest = np.zeros(size, np.uint64), np.full(size, 255, np.uint8)
    for i in range(k):
        h = _mix(h + w[i : size + i])
        rarest = np.minimum(rarest, rare[i : size + i])
    return np.unique((rarest.astype(np.uint64) << np.uint64(56)) | (h & LOW))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1 if size else 0


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= needed(len(x), len(y), percent)


class Member:
    """A set in a bucket: the bucket's token and those after it that others share, their places in the whole set, and
    what its bounds need. Its tokens up to end are complete; before are tokens before the bucket's, as far as held."""

    __slots__ = ("row", "size", "comp", "before", "tokens", "after", "places", "end", "bits", "data")

    def __init__(self, row: int, size: int, comp: int, before: list[int], tokens: list[int], places: list[int], end: int, bits: bytes, data: bytes | None = None):
        self.row, self.size, self.comp, self.tokens, self.places, self.end, self.data = row, size, comp, tokens, places, end, data
        self.bits = 8 * len(bits), int.from_bytes(bits, "little")
        self.before, self.after = frozenset(before), frozenset(tokens[1:])


class Node:
    """A run of tokens of a path, what follows it, the members that end with it, and bounds over the members below.

    least, most: set sizes. rest: how many elements of a set may follow the run. comp: their component if it is one.
    """

    __slots__ = ("run", "tokens", "children", "entries", "least", "most", "rest", "comp")

    def __init__(self, run: list[int], least: int, most: int, rest: int, comp: int | None):
        self.run, self.tokens, self.children, self.entries, self.least, self.most, self.rest, self.comp = run, frozenset(run), {}, [], least, most, rest, comp

    def take(self, m: Member, rest: int) -> None:
        self.least, self.most, self.rest = min(self.least, m.size), max(self.most, m.size), max(self.rest, rest)
        if self.comp != m.comp:
            self.comp = None


class PrefixTree:
    """The members of one bucket as a trie of what follows the bucket's token in their ordered prefixes.

    Runs without a branch are one node. The bucket's token is the root, so every path begins with an overlap of one.
    """

    def __init__(self, percent: int):
        self.percent, self.root = percent, None

    def add(self, m: Member) -> None:
        at, end, rest = 1, len(m.tokens), m.size - m.places[0] - 1
        if self.root is None:
            self.root = Node([], m.size, m.size, rest, m.comp)
        node = self.root
        while True:
            node.take(m, rest)
            if at == end:
                node.entries.append(m)
                return
            child = node.children.get(m.tokens[at])
            if child is None:
                rest = m.size - m.places[-1] - 1
                child = node.children[m.tokens[at]] = Node(m.tokens[at:], m.size, m.size, rest, m.comp)
                at = end
            else:
                same, run = 0, child.run
                while same < len(run) and at + same < end and run[same] == m.tokens[at + same]:
                    same += 1
                if same < len(run):  # the run parts here
                    tail = Node(run[same:], child.least, child.most, child.rest, child.comp)
                    tail.children, tail.entries = child.children, child.entries
                    child = node.children[run[0]] = Node(run[:same], child.least, child.most, node.rest - same, child.comp)
                    child.children[run[same]] = tail
                at += same
                rest = m.size - m.places[at - 1] - 1
            node = child

    def search(self, m: Member) -> Iterator[Member]:
        """Members of other components that may be linked to m and share no token with it before the bucket's.

        The walk keeps (node, overlap so far), which all members below the node share. An element past the end of the
        other's prefix may lie in the rest of that set, so it counts among the remaining ones. A subtree goes once
        the overlap and the lesser of the remaining lengths are under what its least size needs. Pairs with a common
        token before the bucket's belong to that token's bucket. What the tree leaves is held against the parities.
        """
        percent, size, tokens, places, end = self.percent, m.size, m.tokens, m.places, m.end
        smallest = -(-percent * size // 100)
        stack = [(self.root, 1)] if self.root else []
        while stack:
            node, overlap = stack.pop()
            for e in node.entries:
                if e.comp == m.comp or 100 * min(size, e.size) < percent * max(size, e.size) or not m.before.isdisjoint(e.before):
                    continue
                i = bisect_right(tokens, min(e.end, end))
                if overlap + min(size - places[i - 1] - 1, node.rest) >= needed(size, e.size, percent) and differ(m.bits, e.bits) <= allowed(size, e.size, percent):
                    yield e
            for child in node.children.values():
                if child.comp == m.comp or 100 * child.most < percent * size or 100 * size < percent * child.least:
                    continue
                last = child.run[-1]
                c = overlap + len(m.after & child.tokens)
                passed = places[bisect_right(tokens, min(last, end)) - 1] + 1
                rest = child.rest if last <= end else node.rest - bisect_right(child.run, end)
                if c + min(size - passed, rest) >= needed(size, max(child.least, smallest), percent):
                    stack.append((child, c))


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def profiles(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """docs has row, doc_id, text, th (hash of the text). A row for each: its set's size, digest, prefix and parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                sets = [ordered_set(text, n, classes) for text in part.column(2).to_pylist()]
                prefixes = [_signed(x[: prefix_length(len(x), percent)]) for x in sets]
                values = [len(x) for x in sets], [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], prefixes, map(parity, sets)
                kinds = pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()
                columns = [part.column(0), part.column(1), part.column(3), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "th", "n_shingles", "digest", "prefix", "bits"])

    return docs.mapInArrow(run, "row long, doc_id long, th long, n_shingles long, digest binary, prefix array<long>, bits binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int, classes: np.ndarray) -> DataFrame:
    """(row, data) of the wanted (row, doc_id, th, digest), from the texts again: sets are kept for these alone.

    Rows that repeat id and text give their set each, which does no harm where sets are joined to pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = []
                for text, row, digest in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns), strict=True):
                    found = ordered_set(text, n, classes)
                    if xxhash.xxh3_128_digest(found.tobytes()) == digest:
                        rows.append((row, found.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["row", "data"])

    texts = docs.select("doc_id", "th", "text")
    return texts.join(shared.maybe_broadcast(wanted, 64), texts.doc_id.eqNullSafe(wanted.doc_id) & (texts.th == wanted.th)).select("text", "row", "digest").mapInArrow(run, "row long, data binary")


def _grams(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def bucket_members(sets: DataFrame, percent: int) -> DataFrame:
    """row, n, token, at (its place in the set), visit: the prefix tokens that other sets' prefixes have too.

    visit says whether a linked pair can meet there for the first time. Of two linked sets of sizes m <= n the first
    common token is among the first m - ceil(2tm / (1 + t)) + 1 of the smaller one, and sizes of a pair are in one or
    neighbouring classes of a ratio of 1 / t; so counts by token and size class tell, which are summed up before they
    are shuffled, however frequent a token is.
    """
    early = F.col("at") < F.expr(f"n - cast((2 * {percent} * n + {100 + percent} - 1) div {100 + percent} as int) + 1")
    size_class = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent) * 1.000001) if percent < 100 else 1e-6)).cast("int")
    tokens = sets.select("row", "n", size_class.alias("cls"), F.posexplode("prefix").alias("at", "token")).withColumn("early", early)
    counts = tokens.groupBy("token", "cls").agg(F.count("*").alias("c"), F.count_if("early").alias("e"))
    classes = counts.groupBy("token").agg(F.collect_list(F.struct("cls", "c", "e")).alias("k"), F.sum("c").alias("total")).where("total > 1")
    near = "aggregate(filter(k, y -> y.cls between x.cls {}), 0L, (s, y) -> s + y.{})"
    told = F.expr(f"explode(transform(k, x -> struct(x.cls as cls, {near.format('- 1 and x.cls', 'e')} as smaller, {near.format('and x.cls + 1', 'c')} as larger)))")
    several = shared.stage(classes.select("token", told.alias("t")).select("token", "t.*"), "tokens")
    own = F.col("early").cast("int")
    visit = (F.col("smaller") - own >= 1) | (F.col("early") & (F.col("larger") >= 2))
    return tokens.join(shared.maybe_broadcast(several, 32), ["token", "cls"]).select("row", "n", "token", "at", visit.alias("visit"))


KEYS = ["token", "i", "j", "k", "row", "n", "comp", "before", "tokens", "places", "last", "bits"]
#: Of a set's shared tokens a bucket gets so many before its own and after it. A cut prefix has looser bounds only.
HELD = 16


def in_blocks(members: DataFrame, keys: DataFrame, percent: int, block: int = 1000, block_sum: int = 2_000_000) -> DataFrame:
    """The members (token, row, comp) of each bucket with their keys, dealt out as pairs (i, j) of blocks."""
    sized = members.join(keys.select("row", "n"), "row")
    blocks = sized.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_sum)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "token").withColumn("k", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    tasks = dealt.select("token", "row", "comp", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = tasks.select("token", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "row", "comp").join(keys, "row").withColumn("place", F.array_position("tokens", F.col("token")).cast("int"))
    own = {c: F.slice(c, F.col("place"), F.lit(HELD + 1)) for c in ("tokens", "places")}
    last = F.when(F.size("tokens") > F.col("place") + HELD, F.element_at("tokens", F.col("place") + HELD)).otherwise(F.col("last"))
    before = F.slice("tokens", F.lit(1), F.least(F.col("place") - 1, F.lit(HELD)))
    return met.withColumns({"before": before, "last": last, **own}).drop("place")


def met(rows: Iterator[tuple], percent: int) -> Iterator[tuple[Member, Member] | None]:
    """The candidate pairs that the trees of sorted rows (KEYS and data) give; None where another task's rows begin."""
    at, tree = None, None
    for token, i, j, k, *rest in rows:
        if (token, i, j) != at:
            at, tree = (token, i, j), PrefixTree(percent)
            yield None
        member = Member(*rest)
        if i == j or k == j:
            for other in tree.search(member):
                yield member, other
        if k == i:
            tree.add(member)


def active(members: DataFrame, keys: DataFrame, percent: int, block: int = 1000) -> DataFrame:
    """(token, row): the members of a bucket of which the tree there cannot rule out every pair of two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        token = None

        def rows() -> Iterator[tuple]:
            nonlocal token
            for row in shared.rows_of(batches):
                token = row[0]
                yield row

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["token", "row"])
            found.clear()
            return out

        for pair in met(rows(), percent):
            if pair:
                found |= {(token, pair[0].row), (token, pair[1].row)}
            elif len(found) > 10_000:
                yield told()
        yield told()

    tasks = in_blocks(members, keys, percent, block).select(*KEYS)
    return tasks.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "k", "row").mapInArrow(run, "token long, row long").distinct()


def tree_links(members: DataFrame, keys: DataFrame, sets: DataFrame, percent: int, block: int = 500) -> DataFrame:
    """Links (a, b) that join the components (comp) which linked members of a bucket belong to.

    Candidates of the trees are verified on whole sets where they are found. A task gives a link only where it joins two
    components that are apart there, so a bucket gives no more links than it has members, whatever its pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def find(x: int) -> int:
            root.setdefault(x, x)
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])
            found.clear()
            return out

        for pair in met(shared.rows_of(batches), percent):
            if pair is None:
                root.clear()
                if len(found) > 10_000:
                    yield told()
                continue
            x, y = pair
            a, b = find(x.comp), find(y.comp)
            if a != b and linked(_grams(x.data), _grams(y.data), percent):
                root[a] = b
                found.append((x.row, y.row))
        yield told()

    tasks = in_blocks(members, keys, percent, block).join(sets, "row").select(*KEYS, "data")
    return tasks.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "k", "row").mapInArrow(run, "a long, b long")


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, row_col: str | None = None, links_col: str | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id (the least id that links reach) and comp (of rows) for each document.

    row_col names a column that numbers the rows; without it they are numbered here. links_col names a further column
    for the number of other documents, copies among them, that the document is linked to.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    order = sketch(docs, "text")
    profiled = shared.stage(profiles(docs, n, percent, order), "profiles")
    same = profiled.where("n_shingles > 0").groupBy("digest").agg(F.min_by(F.struct("row", "doc_id", "th", F.col("n_shingles").alias("n"), "prefix", "bits"), "row").alias("r"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    each = shared.stage(profiled.select("row", "doc_id", "n_shingles", "digest"), "documents")
    full = shared.stage(same.select("digest", "r.*", "copies", "least"), "sets")
    shared.release(profiled)
    found = shared.stage(bucket_members(full, percent), "members")
    keys = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("token", "at"))).alias("t"), F.bool_or("visit").alias("visit"), F.count_if("visit").alias("weight")).where("visit")
    last = full.select("row", "n", "bits", F.element_at("prefix", -1).alias("last"))
    keys = shared.stage(keys.join(last, "row").select("row", "n", F.col("t.token").alias("tokens"), F.col("t.at").alias("places"), "last", "bits", "weight"), "keys")
    members = shared.stage(found.where("visit").join(keys.select("row", "weight"), "row").select("token", "row", "n", "weight"), "members")
    same = shared.stage(full.drop("prefix", "bits"), "sets")
    shared.release(full, found)
    pairs = shared.stage(by_pivot(members.withColumn("comp", F.col("row")), percent), "pairs")

    def sets_of(rows: DataFrame) -> DataFrame:
        wanted = shared.stage(same.join(shared.maybe_broadcast(shared.stage(rows.distinct(), "rows"), 16), "row", "left_semi").select("row", "doc_id", "th", "digest"), "wanted")
        return shared.stage(whole_sets(docs, wanted, n, order), "grams")

    sets = sets_of(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))))
    links = shared.stage(verify(pairs, sets, _grams, lambda x, y: linked(x, y, percent)), "links")
    comps = components(links)
    known = members.join(comps.withColumnRenamed("node", "row"), "row", "left").select("token", "row", F.coalesce("root", "row").alias("comp"))
    open_ = known.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    now = shared.stage(known.join(open_, "token"), "members")
    keys_only = keys.drop("weight")
    left = shared.stage(active(now, keys_only, percent), "active")
    more = sets_of(left.join(sets.select("row"), "row", "left_anti").select("row"))
    sets = sets.unionByName(more)
    rest = shared.stage(tree_links(now.join(shared.maybe_broadcast(left, 24), ["token", "row"], "left_semi"), keys_only, sets, percent), "links")
    comps = components(links.unionByName(rest))
    shared.release(members, now, keys, left)
    classed = same.join(comps.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("root", "row"))
    least = classed.groupBy("comp").agg(F.min("least").alias("component_id"))
    many = classed.where(F.col("root").isNotNull() | (F.col("copies") > 1)).join(least, "comp").select("row", "digest", "component_id", "comp", "copies")
    if links_col:
        linked_rows = shared.stage(classed.where(F.col("root").isNotNull()).select("row", "comp", "n", "copies"), "linked")
        counted = shared.stage(count_links(linked_rows, sets, _grams, percent), "counts")
        many = many.join(counted, "row", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    many = many.drop("row", "copies")
    many = shared.stage(many, "classes")
    joined = each.join(shared.maybe_broadcast(many, 72), "digest", "left")
    told = [F.coalesce("links", F.lit(0)).cast("long").alias(links_col)] if links_col else []
    return joined.select("row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("comp", "row").alias("comp"), *told)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one of each class: that of the least id (nulls last), then of the first row."""
    number = shared.free_name(docs, "__row")
    numbered = shared.stage(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    classes = shared.stage(classes_of(numbered, id_col, text_col, n, percent, number), "classes")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = classes.groupBy("comp").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("comp", "first")
    first = shared.maybe_broadcast(shared.stage(first, "first"), 64)
    later = shared.stage(classes.join(first, "comp").where("row <> first.row").select(F.col("row").alias(number)), "later")
    return numbered.join(shared.maybe_broadcast(later, 16), number, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
