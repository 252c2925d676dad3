"""Fuzzy line dedup by MinHash: one line of each component of near-alike lines stays in the corpus.

1. Every line with a word gets its hash (its node: equal lines are one node) and the MinHash signature of its
   character shingles, cut into bands. A line shorter than a shingle is its own only shingle.
2. Bands that lines of two or more nodes share are buckets; buckets of equal lines alone count as none, and those of
   equal sets of nodes as one. The members of a bucket meet in blocks, and what is then apart in pairs of blocks. Sizes
   and parities of the shingle sets say which members have a possible partner there; these come once more with their
   texts, and similarity is verified on the shingle sets of whole lines. A task gives a link only where it joins two
   components that are still apart, so a bucket gives no more links than it has members.
3. Verified links give components by distributed union-find. Of a component's lines the first in order of doc_id,
   row and line number stays. Least positions are aggregated before the shuffle, so a line that makes up a third of
   the corpus is no heavier a task than others.

With rows shingles a band and bands of them, a pair of similarity s meets with probability 1 - (1 - s^rows)^bands:
0.994 at 0.8 and over 0.9999 at 0.9 as set here, and 0.012 at 0.3, which lines of one language reach by common words.

Defined cases: a null text stays null and an empty one empty; lines without a word always stay; repeated rows are rows
of their own, of which the later lose their lines; a null doc_id comes last; an empty table gives an empty table;
further columns pass through, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .components import components
from .setbits import allowed, differ

SPACE = " \t\n\v\f\r"
SHINGLE, ROWS, BANDS = 5, 6, 17
BASE = 0x9E3779B97F4A7C15


def shingle_hashes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles that begin at each character of the lines put together, and each line's first and end."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    text = np.frombuffer(("".join(lines) + "\0" * shingle).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1])
    power, span, rolled, done = BASE, 1, text, 0
    h = None
    while done < shingle:  # windows of 1, 2, 4, ... joined to the wanted width
        if shingle & span:
            h = rolled[:total] if h is None else h[:total] * np.uint64(power) + rolled[done : done + total]
            done += span
            if done == shingle:
                break
        rolled = rolled[:-span] * np.uint64(power) + rolled[span:]
        power, span = power * power % (1 << 64), span * 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    short = sizes < shingle
    for i in np.flatnonzero(short):
        h[starts[i]] = xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
    return h, starts, np.where(short, starts + 1, ends - shingle + 1)


def filled(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The hashes with each line's first one where none of its shingles begins."""
    h, ends = h.copy(), np.append(starts[1:], len(h))
    for k in range(int((ends - stops).max())):
        rest = stops + k < ends
        h[stops[rest] + k] = h[starts[rest]]
    return h


#: Bits of a shingle's hash that tell it from others of its line; the rest of 64 number the lines that go together.
OWN = 54


def distinct_shingles(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The distinct shingles of each of at most 1024 lines, by line: its number above OWN bits of the hash."""
    keys = filled(h, starts, stops) & np.uint64((1 << OWN) - 1)
    keys |= np.repeat(np.arange(len(starts), dtype=np.uint64) << np.uint64(OWN), np.diff(starts, append=len(h)))
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])]


def sizes_of(keys: np.ndarray, lines: int) -> np.ndarray:
    """How many of distinct_shingles each line has."""
    return np.bincount((keys >> np.uint64(OWN)).astype(np.int64), minlength=lines)


def distinct_halves(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 32 bits of the distinct shingles' hashes of each of at most 512 lines, by line, and how many each has, by one sort in place."""
    keys = (filled(h, starts, stops) >> np.uint64(64 - OWN)).view(np.int64)
    keys |= np.repeat(np.arange(len(starts)) << OWN, np.diff(starts, append=len(h)))
    keys.sort()
    fresh = np.append(True, keys[1:] != keys[:-1])
    return (keys[fresh] >> (OWN - 32)).astype(np.uint32), np.add.reduceat(fresh, starts, dtype=np.int64)


def counted_shingles(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """How many distinct shingles each of at most 512 lines has."""
    return distinct_halves(h, starts, stops)[1]


def heads_of(keys: np.ndarray, lines: int) -> list[bytes]:
    """For Line: size, slots and parity (as setbits.parity gives it) of each line's distinct_shingles, counted for all lines at once."""
    size = sizes_of(keys, lines)
    slots = np.clip(1 << np.ceil(np.log2(size)).astype(np.int64), 64, 1 << 13)
    begin = np.cumsum(slots) - slots
    line = (keys >> np.uint64(OWN)).astype(np.int64)
    slot = begin[line] + (keys & (slots[line] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(slot, minlength=int(slots.sum())) & 1).astype(np.uint8), bitorder="little")
    return [struct.pack("<IH", n, k) + bits[b // 8 : (b + k) // 8].tobytes() for n, k, b in zip(size.tolist(), slots.tolist(), begin.tolist(), strict=True)]


def least_hashes(halves: np.ndarray, sizes: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """The MinHash signature of each line, from distinct_halves: len(sizes) by rows * bands least hashes."""
    starts = np.cumsum(sizes) - sizes
    least, hashed = np.empty((rows * bands, len(sizes)), np.uint32), np.empty_like(halves)
    for k, mul in enumerate(np.random.default_rng(20250101).integers(0, 1 << 32, rows * bands, np.uint64)):
        np.multiply(halves, np.uint32(mul | np.uint64(1)), out=hashed)  # the hashes are mixed, so no summand is needed
        np.minimum.reduceat(hashed, starts, out=least[k])
    return least.T


def signatures(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The MinHash signature of each of at most 512 lines, from its shingles' hashes."""
    return least_hashes(*distinct_halves(h, starts, stops))


def band_keys(least: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """Band keys of signatures: len(least) by bands."""
    keys = np.empty((len(least), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(least), b + 1, np.uint64)
        for r in range(rows):
            x = (x ^ least[:, b * rows + r]) * np.uint64(BASE)
            x ^= x >> np.uint64(31)
        keys[:, b] = x
    return keys


def shingle_set(data: bytes, shingle: int = SHINGLE) -> set[str]:
    line = data.decode("utf-8", "surrogatepass")
    return {line[i : i + shingle] for i in range(max(1, len(line) - shingle + 1))}


#: Bits that hold a character and one more, for the places after a line shorter than a shingle; SHINGLE of these fit a number.
CHAR = 12


def shingle_numbers(data: bytes) -> np.ndarray | None:
    """shingle_set as numbers in ascending order, which are equal just where the shingles are; None if a character is too large."""
    text = np.frombuffer(data, np.uint8) if data.isascii() else np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    if text.max(initial=0) >= (1 << CHAR) - 1:
        return None
    chars = np.zeros(max(len(text), SHINGLE), np.int64)
    chars[: len(text)] = text
    chars[: len(text)] += 1
    n = len(chars) - SHINGLE + 1
    numbers = chars[:n].copy()
    for i in range(1, SHINGLE):
        numbers <<= CHAR
        numbers |= chars[i : n + i]
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])]


def enough(both: int, x: int, y: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both)


def alike(x: set[str], y: set[str], percent: int) -> bool:
    return enough(len(x & y), len(x), len(y), percent)


class Line:
    """A line as it is compared: the number of its shingles, their parity (see setbits) and, once wanted, their set and numbers."""

    __slots__ = ("size", "bits", "text", "_set", "_numbers")

    def __init__(self, head: bytes, text: bytes | None = None):
        self.size, slots = struct.unpack_from("<IH", head)
        self.bits, self.text, self._set, self._numbers = (slots, int.from_bytes(head[6:], "little")), text, None, False

    @property
    def shingles(self) -> set[str]:
        if self._set is None:
            self._set = shingle_set(self.text)
        return self._set

    @property
    def numbers(self) -> np.ndarray | None:
        if self._numbers is False:
            self._numbers = shingle_numbers(self.text)
        return self._numbers

    def possible(self, other: Line, percent: int) -> bool:
        """False only where sizes or parities rule the similarity out."""
        x, y = self.size, other.size
        return 100 * min(x, y) >= percent * max(x, y) and differ(self.bits, other.bits) <= allowed(x, y, percent)

    def alike(self, other: Line, percent: int) -> bool:
        if not self.possible(other, percent):
            return False
        x, y = self.numbers, other.numbers
        if x is None or y is None:
            return alike(self.shingles, other.shingles, percent)
        merged = np.concatenate((x, y))
        merged.sort()
        return enough(int(np.count_nonzero(merged[1:] == merged[:-1])), len(x), len(y), percent)


def comparable(texts: DataFrame) -> DataFrame:
    """(row, head, data) for Line from (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                lines = part.column(1).to_pylist()
                heads = heads_of(distinct_shingles(*shingle_hashes(lines, SHINGLE)), len(lines))
                data = [x.encode("utf-8", "surrogatepass") for x in lines]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(heads, pa.binary()), pa.array(data, pa.binary())], ["row", "head", "data"])

    return texts.mapInArrow(run, "row long, head binary, data binary")


def worded_lines(numbered: DataFrame) -> DataFrame:
    """__row, __id, line (its number), node of each line with a word."""
    each = numbered.select("__row", "__id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return each.where(F.ltrim("text", F.lit(SPACE)) != "").select("__row", "__id", "line", F.xxhash64("text").alias("node"))


PAIR = np.dtype([("token", "<i8"), ("node", "<i8"), ("size", "<u2")])
WHOLE = np.dtype((np.void, PAIR.itemsize))  # as which rows are copied at once and not by field


def of_shared_tokens(pairs: np.ndarray) -> np.ndarray:
    """The rows of PAIR whose token more than one row has. Few are, so only tokens are sorted, and looked up by low bits first."""
    token = np.ascontiguousarray(pairs["token"])
    ordered = np.sort(token)
    several = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    low = np.zeros(1 << 20, bool)
    low[several & (len(low) - 1)] = True
    rows = np.flatnonzero(low[token & (len(low) - 1)])
    at = np.searchsorted(several, token[rows])
    at[at == len(several)] = 0
    return pairs[rows[several[at] == token[rows]]] if len(rows) else pairs[:0]


def distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    """The distinct rows of PAIR, by token, size and node."""
    pairs = pairs[np.lexsort((pairs["node"], pairs["size"], pairs["token"]))]
    return pairs[np.append(True, (pairs["token"][1:] != pairs["token"][:-1]) | (pairs["node"][1:] != pairs["node"][:-1]))] if len(pairs) else pairs


def set_names(token: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each member (token, node) of buckets, by token, a name of its bucket that tells the set of its nodes: their sum."""
    if not len(token):
        return token
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    return np.repeat(np.add.reduceat(node, begins), np.diff(begins, append=len(token)))


def line_pairs(lines: list[str], nodes: list[int]) -> np.ndarray:
    """PAIR of each line and band."""
    keys, sizes = [], []
    for k in range(0, len(lines), 500):
        halves, counts = distinct_halves(*shingle_hashes(lines[k : k + 500], SHINGLE))
        keys.append(band_keys(least_hashes(halves, counts)))
        sizes.append(counts)
    pairs = np.empty(len(lines) * BANDS, PAIR)
    pairs["token"] = np.concatenate(keys).ravel().view(np.int64)
    pairs["node"] = np.repeat(np.array(nodes, np.uint64).view(np.int64), BANDS)
    pairs["size"] = np.repeat(np.minimum(np.concatenate(sizes), 65535), BANDS)
    return pairs


def shared_bands(numbered: DataFrame, lines: int, percent: int, held: int = 1 << 20) -> DataFrame:
    """(token, row): the nodes of each band that have another one there of a size that allows the similarity.

    Lines that are alike mostly share several bands, with nobody else: a token names the set of a bucket's nodes, so
    buckets of equal sets are one. Should two sets have one name, their members meet in one bucket, and none is missed.

    Nearly all bands are of one node. So the pairs go from the texts to their tasks at once, in packed form, 18 bytes
    each and those of a line once for every `held` pairs of a task, and leave it only if they are shared. A task gets
    about 2 ** 21 pairs of the lines there are. Of a band's nodes in the order of their sizes, the neighbours tell
    whether any other fits.
    """
    spark = numbered.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines * BANDS // (1 << 21)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate([x.view(WHOLE) for x in kept]).view(PAIR) if kept else np.empty(0, PAIR)
            kept.clear()
            seen.clear()
            part = (pairs["token"].astype(np.uint64) >> np.uint64(11)) % np.uint64(parts)
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
            names, begins = np.unique(part[order], return_index=True)
            blobs = [x.tobytes() for x in np.split(pairs.view(WHOLE)[order], begins[1:])] if len(pairs) else []
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "pairs"])

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                new: dict[int, str] = {}
                for text in batch.column(0).slice(i, 200).to_pylist():
                    for line in (text or "").split("\n"):
                        if line.strip(SPACE) and (node := xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)) not in seen:
                            seen.add(node)
                            new[node] = line
                if new:
                    kept.append(line_pairs(list(new.values()), list(new)))
                if sum(map(len, kept)) >= held:
                    yield flush()
        yield flush()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), PAIR)
        pairs = distinct_pairs(of_shared_tokens(pairs))
        token, size = pairs["token"], pairs["size"].astype(np.int64)
        fits = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
        many = pairs[np.append(fits, False) | np.append(False, fits)] if len(pairs) else pairs
        token, node = set_names(many["token"], many["node"]), np.ascontiguousarray(many["node"])
        for i in range(0, len(many), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (token, node)], ["token", "row"])

    packed = numbered.select("text").mapInArrow(pack, "part long, pairs binary")
    return packed.repartition(parts, "part").mapInArrow(unpack, "token long, row long").distinct()


def in_blocks(members: DataFrame, crossing: bool, block: int) -> DataFrame | None:
    """The members (token, row, comp) of each bucket in tasks: one block, or with crossing a pair (i, j) of them.

    Which block of a bucket a row is in differs from bucket to bucket, so rows that share several bands meet in one.
    None if there is nothing to cross, as no bucket has two blocks.
    """
    large = members.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    large = shared.stage(large, "large")
    if crossing and large.isEmpty():
        return None
    large = shared.maybe_broadcast(large, 16)
    dealt = members.join(large, "token", "inner" if crossing else "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("row", "token"), F.col("blocks")).cast("int"))
    others = F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("k")) if crossing else F.array("k")
    tasks = dealt.select("token", "row", "comp", "k", F.explode(others).alias("o"))
    return tasks.select("token", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "row", "comp")


def by_task(tasks: DataFrame, work: Callable[[list[list]], list[tuple[int, int]]], names: tuple[str, str]) -> DataFrame:
    """work gives pairs of numbers for the members of each task, if these are of two or more components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], list(names))
            found.clear()
            return out

        def done() -> None:
            if len({h[3] for h in held}) > 1:
                found.extend(work(held))

        for batch in batches:
            for row in zip(*(c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy().tolist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    done()
                    at, held = row[:3], []
                    if len(found) > 10_000:
                        yield told()
                held.append([row[0], *row[3:5], *row[5:]])
        done()
        yield told()

    columns = [F.col(c) for c in ("token", "i", "j", "k", "row", "comp")] + [F.col(c) for c in tasks.columns if c in ("head", "data")]
    return tasks.select(*columns).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "k", "row").mapInArrow(run, f"{names[0]} long, {names[1]} long")


def active(tasks: DataFrame, percent: int, crossing: bool) -> DataFrame:
    """(token, row): the members that have a partner in a task which sizes and parities do not rule out."""

    def work(held: list[list]) -> list[tuple[int, int]]:
        some, on = [(k, comp, Line(head)) for _, k, _, comp, head in held], [False] * len(held)
        for i, (k, comp, x) in enumerate(some):
            for j in range(i + 1, len(some)):
                o, other, y = some[j]
                if not (on[i] and on[j] or comp == other or crossing and k == o) and x.possible(y, percent):
                    on[i] = on[j] = True
        return [(h[0], h[2]) for h, x in zip(held, on, strict=True) if x]

    return by_task(tasks, work, ("token", "row")).distinct()


def linked(tasks: DataFrame, percent: int, crossing: bool) -> DataFrame:
    """Verified links (a, b) that join components which meet in a task: enough of them to join all that are linked."""

    def work(held: list[list]) -> list[tuple[int, int]]:
        some, root, found = [(k, row, comp, Line(head, data)) for _, k, row, comp, head, data in held], {h[3]: h[3] for h in held}, []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, (k, a, comp_a, x) in enumerate(some):
            for o, b, comp_b, y in some[i + 1 :]:
                if crossing and k == o:
                    continue
                p, q = find(comp_a), find(comp_b)
                if p != q and x.alike(y, percent):
                    root[p] = q
                    found.append((a, b))
        return found

    return by_task(tasks, work, ("a", "b"))


def link_blocks(members: DataFrame, payloads: DataFrame, percent: int, crossing: bool, one_bucket: bool = False, block: int = 1000) -> DataFrame | None:
    """Verified links (a, b) between the members (token, row, comp) of buckets, by one rule in buckets of any size; None if nothing is to cross.

    With one_bucket a member brings its text to one bucket only, of those where it has a possible partner that with
    most such members; that joins most of what is linked, as rows that share one band mostly share others.
    """
    tasks = in_blocks(members, crossing, block)
    if tasks is None:
        return None
    on = shared.stage(active(tasks.join(payloads.select("row", "head"), "row"), percent, crossing), "active")
    if one_bucket:
        counted = on.join(on.groupBy("token").agg(F.count("*").alias("c")), "token")
        chosen = shared.stage(counted.groupBy("row").agg(F.max(F.struct("c", "token")).alias("m")).select("m.token", "row"), "chosen")
        shared.release(on)
        on = chosen
    met = tasks.join(shared.maybe_broadcast(on, 24), ["token", "row"], "left_semi").join(payloads, "row")
    out = shared.stage(linked(met, percent, crossing), "links")
    shared.release(on)
    return out


def line_components(numbered: DataFrame, lines: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that are alike to others."""
    members = shared.stage(shared_bands(numbered, lines, percent), "members")
    wanted = shared.stage(members.select("row").distinct(), "wanted")
    texts = numbered.select(F.explode(F.split("text", "\n")).alias("text")).select(F.xxhash64("text").alias("row"), "text")
    texts = texts.join(shared.maybe_broadcast(wanted, 16), "row", "left_semi").dropDuplicates(["row"])
    payloads = shared.stage(comparable(texts), "texts")
    shared.release(wanted)
    links, now, comps = [], members.withColumn("comp", F.col("row")), None
    for crossing, one_bucket in ((False, True), (False, False), (True, False)):
        found = link_blocks(now, payloads, percent, crossing, one_bucket)
        if found is None:
            shared.release(now)
            break
        links.append(found)
        if comps is not None:
            shared.release(now, comps)
        comps = components(reduce(DataFrame.unionByName, links))
        if not crossing:
            known = members.join(shared.maybe_broadcast(comps.withColumnRenamed("node", "row"), 16), "row", "left").select("token", "row", F.coalesce("root", "row").alias("comp"))
            several = known.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
            now = shared.stage(known.join(several, "token"), "members")  # whole buckets, so that blocks are as they were
    shared.release(members, payloads, *links)
    return comps


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, out: str | None = None) -> DataFrame:
    """docs with later near-alike lines gone from text_col, and a struct column: lines (with a word) and removed (of these).

    The struct is the last column; its name is out, or else one that docs has not.
    """
    out = out or shared.free_name(docs, "__lines")
    number, drop = shared.free_name(docs, "__row"), shared.free_name(docs, "__gone")
    whole = shared.stage_texts(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    numbered = whole.select(F.col(number).alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lines = shared.stage(worded_lines(numbered), "lines")
    comps = line_components(numbered, lines.count(), percent)
    alone = lines.join(shared.maybe_broadcast(comps, 16), "node", "left").select("__row", "line", F.coalesce("root", "node").alias("comp"), F.struct(F.col("__id").isNull().alias("none"), "__id", "__row", "line").alias("place"))
    first = alone.groupBy("comp").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1").select("comp", "first")
    later = alone.join(shared.maybe_broadcast(shared.stage(first, "first"), 48), "comp").where("place <> first")
    gone = shared.stage(later.groupBy(F.col("__row").alias(number)).agg(F.collect_set("line").alias(drop)), "gone")
    shared.release(lines, comps)
    kept = whole.join(shared.maybe_broadcast(gone, 64), number, "left").select(*(F.col(f"`{c}`") for c in docs.columns), drop)
    at = docs.columns.index(text_col)
    names = [*docs.columns, out]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts, total, removed = [], [], []
                for text, drop in zip(part.column(at).to_pylist(), part.column(len(names) - 1).to_pylist(), strict=True):
                    parts, drop = (text or "").split("\n"), set(drop or ())
                    total.append(sum(1 for x in parts if x.strip(SPACE)))
                    removed.append(len(drop))
                    texts.append("\n".join(x for n, x in enumerate(parts) if n not in drop) if drop else text)
                counts = pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["lines", "removed"])
                columns = [*part.columns[: at], pa.array(texts, pa.string()), *part.columns[at + 1 : len(names) - 1], counts]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema] + [T.StructField(out, T.StructType([T.StructField(c, T.LongType()) for c in ("lines", "removed")]))])
    return shared.map_rows(kept, rewrite, schema)
