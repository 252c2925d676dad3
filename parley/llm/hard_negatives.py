"""Hard-negative mining by a vector-approximation file.

Vectors are scaled to integers. Each dimension is cut into cells of equal width over the range of a sample, the first
and the last reaching to the least and greatest component of all rows, and a row is kept as one byte a dimension: the
approximation file, an eighth of the vectors. The cells' bounds, looked up by a row's codes, give a lower and an upper
bound of its score with an anchor. Two passes of blocks of anchors over that file alone, in packed rows:

1. Of the rows of an anchor's label, those whose upper bound reaches the k-th best lower bound may be positives.
2. Of the other rows, those whose bounds meet the window of a positive's score may be negatives; once k rows lie inside
   the window for sure, only those whose upper bound reaches the k-th best lower bound of these.

Both bars are kept while a task reads and are then taken over all tasks. Only what passes is joined with whole vectors
and scored exactly, in integers. Of rows with the same label and vector only the first ids can be chosen, so a vector
that a third of all rows hold counts as a few rows before anything is compared. A block holds at most BLOCK anchors
and the codes are dealt in parts, so that a task reads a bounded piece of both.

Scores are integer inner products; higher ones come first, ties by the lesser id.

Defined cases: rows whose id, label or vector is null, whose vector is empty, or that have a null or non-finite
component, also after scaling, take no part; vectors of other lengths than an anchor's are not compared with it; rows
alike in id, label and vector are one, and rows with the anchor's own id are neither positives nor negatives of it; scores beyond
64 bits are taken for the nearest such number; fewer rows than k give fewer rows; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Anchors of a block, rows of a part, and the pieces of either that are compared at a time.
BLOCK, PART, ANCHORS, ROWS = 4096, 8192, 512, 2048
#: Sums of integers below this are exact in doubles.
EXACT = 2.0**52
LONG = 2**63


@dataclass(frozen=True)
class Cells:
    """low and high: the bounds of each cell, dimensions by cells; edges: the first number of all but the first."""

    edges: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.uint8)

    def bounds(self, anchors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, anchors by rows."""
        at = np.arange(len(self.edges))
        low, high = self.low[at, codes], self.high[at, codes]
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
            widest = max(np.abs(self.low).max(), np.abs(self.high).max()) * max(1.0, np.abs(anchors).max()) * len(self.edges)
            if not widest < EXACT:
                slack = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T * 2.0**-40
                least, most = (np.clip(np.where(np.isnan(x), side, x), -LONG, LONG) for x, side in ((least - slack, -np.inf), (most + slack, np.inf)))
        return least, most


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    begins = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        places = np.flatnonzero(lengths == d)
        yield places, flat[begins[places][:, None] + np.arange(d)]


def usable(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """row, id, label, x (scaled) of the rows that take part, written down."""
    v = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda c: c * scale)
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("x")).where(sound & F.col("id").isNotNull() & F.col("label").isNotNull())

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            whole = pa.array(np.floor(x.flatten().to_numpy(zero_copy_only=False)) + 0.0)
            lengths = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(lengths), whole)], ["id", "label", "x"])

    one = rows.mapInArrow(floored, "id long, label long, x array<double>").dropDuplicates(["id", "label", "x"])
    return shared.stage(one.withColumn("row", F.monotonically_increasing_id()), "scaled")


def fit(rows: DataFrame, cells: int = 256, sample: int = 4096) -> dict[int, Cells]:
    """Cells for each length of vectors: ranges of at most 2 * sample rows by the hash of their ids, extremes of all."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                d = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0))], ["dim", "at", "low", "high"])

    ends = rows.select("x").mapInArrow(extremes, "dim int, at int, low double, high double").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "at").collect()
    known = {d: np.array([(r.low, r.high) for r in ends if r.dim == d]) for d in {r.dim for r in ends}}
    out = {}
    for d, n in sorted((r.dim, r.n) for r in rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()):
        own = rows.where(F.size("x") == d)
        some = own.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample))) == 0).select("x").limit(2 * sample).collect() or own.select("x").limit(sample).collect()
        x = np.array([r.x for r in some])
        first, last = np.quantile(x, 0.001, axis=0, method="lower"), np.quantile(x, 0.999, axis=0, method="higher")
        edges = [np.unique(np.ceil(np.linspace(a, b + 1, cells - 1))) for a, b in zip(first, last, strict=True)]
        low, high = np.zeros((d, cells)), np.zeros((d, cells))
        for j, e in enumerate(edges):
            low[j, 1 : len(e) + 1], high[j, : len(e)] = e, e - 1
            low[j, 0], high[j, len(e)] = min(known[d][j, 0], e[0] - 1), max(known[d][j, 1], e[-1])
        out[d] = Cells(edges, low, high)
    return out


PACKED = "dim int, first long, rows binary, ids binary, labels binary, data binary, told binary"
PACKED_ARROW = pa.schema([("dim", pa.int32()), ("first", pa.int64()), *((c, pa.binary()) for c in ("rows", "ids", "labels", "data", "told"))])


def packed(rows: DataFrame, size: int, cells: dict[int, Cells] | None = None, told_by: int = 0) -> DataFrame:
    """rows (row, id, label, x and, for told_by, targets) as rows of at most `size` each: codes if there are cells, else x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "id", "label")]
            targets = np.full((batch.num_rows, told_by), np.nan)
            for i, found in enumerate(batch.column("targets").to_pylist() if told_by else ()):
                for t in found:
                    targets[i, t["slot"] - 1] = t["score"]
            for places, x in by_length(batch.column("x")):
                for i in range(0, len(places), size):
                    own, some = places[i : i + size], x[i : i + size]
                    data = cells[x.shape[1]].codes(some) if cells else some
                    columns = [*(n[own].tobytes() for n in numbers), data.tobytes(), targets[own].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([x.shape[1], int(numbers[0][own[0]]), *columns], PACKED_ARROW, strict=True)], schema=PACKED_ARROW)

    return rows.select("row", "id", "label", "x", *(["targets"] if told_by else [])).mapInArrow(run, PACKED)


class Piece:
    """One packed row."""

    def __init__(self, dim: int, rows: bytes, ids: bytes, labels: bytes, data: bytes, told: bytes, kind: type, told_by: int = 0):
        self.dim = dim
        self.rows, self.ids, self.labels = (np.frombuffer(b, np.int64) for b in (rows, ids, labels))
        self.data, self.told = np.frombuffer(data, kind).reshape(len(self.rows), -1), np.frombuffer(told).reshape(len(self.rows), told_by)


class Bar:
    """The k best lower bounds so far for each anchor, and what may reach them: (anchor, row, slot, low, high, sure)."""

    def __init__(self, anchors: Piece, k: int, slot: int):
        self.rows, self.slot, self.k, self.best, self.found = anchors.rows, slot, k, np.full((len(anchors.rows), k), -np.inf), []

    def take(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, sure: np.ndarray, may: np.ndarray) -> None:
        better = sure & (low > self.best.min(1)[:, None])
        own = np.flatnonzero(better.any(1))
        if len(own):
            both = np.concatenate([self.best[own], np.where(better[own], low[own], -np.inf)], 1)
            self.best[own] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        a, r = np.nonzero(may & (high >= self.best.min(1)[:, None]))
        self.found.append((a, rows[r], low[a, r], high[a, r], sure[a, r]))

    def told(self) -> Iterator[pa.RecordBatch]:
        bar = self.best.min(1)
        for a, r, low, high, sure in self.found:
            left = high >= bar[a]
            columns = [self.rows[a[left]], r[left], np.full(left.sum(), self.slot, np.int32), low[left], high[left], sure[left]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "row", "slot", "low", "high", "sure"])


HITS = "anchor long, row long, slot int, low double, high double, sure boolean"


def scanned(anchors: DataFrame, file: DataFrame, sizes: tuple[int, int], cells: dict[int, Cells], k: int, meet: Callable, slots: int, told_by: int = 0) -> DataFrame:
    """What may be among the k best of a slot, by blocks of anchors and parts of the file; sizes: rows of both."""
    blocks, parts = -(-max(1, sizes[0]) // BLOCK), -(-max(1, sizes[1]) // PART)
    of = lambda n: F.pmod(F.xxhash64("first"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fields = ("dim", "rows", "ids", "labels", "data", "told")
    asked = anchors.select(of(blocks).alias("b"), each(parts).alias("p"), F.lit(0).alias("kind"), *fields)
    held = file.select(each(blocks).alias("b"), of(parts).alias("p"), F.lit(1).alias("kind"), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, groups = None, []
        for batch in batches:
            for b, p, kind, *packed_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (packed_row[0], b, p) != at:
                    for _, bars in groups:
                        for bar in bars:
                            yield from bar.told()
                    at, groups = (packed_row[0], b, p), []
                if kind == 0:
                    piece = Piece(*packed_row, np.float64, told_by)
                    groups.append((piece, [Bar(piece, k, s + 1) for s in range(slots)]))
                elif groups:
                    piece = Piece(*packed_row, np.uint8)
                    for own, bars in groups:
                        low, high = cells[own.dim].bounds(own.data, piece.data)
                        meet(own, piece, low, high, bars)
        for _, bars in groups:
            for bar in bars:
                yield from bar.told()

    met = asked.unionByName(held).repartition("dim", "b", "p").sortWithinPartitions("dim", "b", "p", "kind")
    hits = shared.stage(met.select("b", "p", "kind", *fields).mapInArrow(run, HITS), "hits")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("low"), "row")
    bar = hits.where("sure").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("low").alias("bar"))
    return hits.join(bar.where(F.col("n") == k).drop("n"), ["anchor", "slot"], "left").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("anchor", "slot", "row")


def exact_scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """anchor, row, id, score of each (anchor, row), from whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows, np.int64)
            for (places, a), (_, x) in zip(by_length(batch.column("a")), by_length(batch.column("x")), strict=True):
                with np.errstate(over="ignore"):
                    safe = (np.abs(a).max(1) * np.abs(x).max(1) * a.shape[1]) < EXACT
                scores[places[safe]] = (a[safe] * x[safe]).sum(1).astype(np.int64)
                for i in np.flatnonzero(~safe):
                    whole = sum(int(p) * int(q) for p, q in zip(a[i].tolist(), x[i].tolist(), strict=True))
                    scores[places[i]] = min(max(whole, -LONG), LONG - 1)
            yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("row"), batch.column("id"), pa.array(scores)], ["anchor", "row", "id", "score"])

    vectors = rows.select("row", "id", "x")
    met = pairs.select("anchor", "row").distinct().join(vectors, "row").join(vectors.select(F.col("row").alias("anchor"), F.col("x").alias("a")), "anchor")
    return met.select("anchor", "row", "id", "x", "a").mapInArrow(run, "anchor long, row long, id long, score long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, cells: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor is over the column id; label is an expression over the table, its column `label` unless told. A negative
    of a positive scores window[0] to window[1] hundredths of it. At most 256 cells: a code is one byte.
    """
    least, most = window
    rows = usable(vectors, id_col, F.col("label") if label is None else label, vector_col, scale)
    model = fit(rows, cells)
    alike = Window.partitionBy("label", "x").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= max(positives, negatives) + 1).drop("n")
    file = shared.stage(packed(first, ROWS, model), "approximations")
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    sizes = anchors.count(), file.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 8

    def same(own: Piece, piece: Piece, low: np.ndarray, high: np.ndarray, bars: list[Bar]) -> None:
        may = (own.labels[:, None] == piece.labels) & (own.ids[:, None] != piece.ids)
        bars[0].take(piece.rows, low, high, may, may)

    def other(own: Piece, piece: Piece, low: np.ndarray, high: np.ndarray, bars: list[Bar]) -> None:
        fits = (own.labels[:, None] != piece.labels) & (own.ids[:, None] != piece.ids)
        low100, high100 = 100 * low, 100 * high
        for i, bar in enumerate(bars):
            begin, end = least * own.told[:, i : i + 1], most * own.told[:, i : i + 1]
            may = fits & (high100 >= begin) & (low100 <= end)
            bar.take(piece.rows, low, high, may & (low100 >= begin) & (high100 <= end), may)

    near = scanned(packed(anchors, ANCHORS), file, sizes, model, positives, same, 1)
    by_score = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    best = exact_scores(near, rows).withColumn("slot", F.row_number().over(by_score)).where(F.col("slot") <= positives)
    best = shared.stage(best.select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    targets = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("slot", F.col("positive_score").cast("double").alias("score"))).alias("targets"))
    aimed = packed(anchors.join(targets, "row"), ANCHORS, told_by=positives)
    hits = shared.stage(scanned(aimed, file, sizes, model, negatives, other, positives, positives), "hits")
    scored = exact_scores(hits, rows).select("anchor", "row", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    inside = (F.col("positive_score").cast("decimal(38,0)") * least <= F.col("negative_score").cast("decimal(38,0)") * 100) & (F.col("negative_score").cast("decimal(38,0)") * 100 <= F.col("positive_score").cast("decimal(38,0)") * most)
    met = hits.join(scored, ["anchor", "row"]).join(best, ["anchor", "slot"]).where(inside)
    by_negative = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id", "row")
    told = met.withColumn("rank", F.row_number().over(by_negative)).where(F.col("rank") <= negatives)
    names = rows.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return told.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
