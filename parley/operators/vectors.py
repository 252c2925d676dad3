"""Exact dense ranking by dot products, with cells of rows that a query need not read.

Rows are dealt to the nearest of some pivots and, by their distance from it, to rings: a ring of a pivot is a cell. For
a query q and a cell around the pivot c, no row scores more than q.c + |q| d, where d is the cell's greatest distance
(Cauchy-Schwarz), nor more than |q| times the greatest norm times the cosine of the angle between q and c less that of
the cell (the triangle of angles). Each query first reads the cells of the greatest q.c that hold k rows; its k-th score
there is a bar, and of the other cells only those whose bound reaches it are read. The result is exact.

Each row is shuffled once to a block of its cell, whatever the number of queries; queries go to the blocks of the cells
that they read. A task holds one block and streams the queries through it. Nothing is collected but the pivots and a
line for each cell, whose numbers are parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import written

#: Pivots at most, rings of each, rows of a block.
PIVOTS, RINGS, BLOCK = 1024, 4, 8192
#: Scores are compared with bounds at this distance, as they are ranked at nine places.
NEAR = 1e-8


@dataclass(frozen=True)
class Outline:
    """Of each cell its number, pivot, greatest distance, angle and norm, rows and blocks."""

    cell: np.ndarray
    pivot: np.ndarray
    far: np.ndarray
    wide: np.ndarray
    norm: np.ndarray
    n: np.ndarray
    blocks: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that a row of each cell can score, queries by cells."""
        dots, length = q @ self.pivot.T, np.linalg.norm(q, axis=1)[:, None]
        scale = length * np.linalg.norm(self.pivot, axis=1)
        cosine = np.divide(dots, scale, out=np.ones_like(dots), where=scale > 0)
        apart = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - self.wide, 0)
        by_angle = length * self.norm * np.maximum(np.cos(apart), 0)
        return np.minimum(dots + length * self.far, by_angle) * (1 + 1e-9) + NEAR * (1 + length * self.norm)


@dataclass(frozen=True)
class Cells:
    """rows: cell, block, id, v."""

    rows: DataFrame
    outline: Outline


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def cells(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> Cells:
    """vectors: id, v (of one length). There are sqrt(n) pivots, `pivots` at most: rows of evenly spaced hashes."""
    vectors = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    n = vectors.count()
    some = min(pivots, math.isqrt(n) + 1)
    share = max(1, n // (4 * some))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("v").limit(some).collect() or vectors.select("v").limit(some).collect()
    center = np.array([r.v for r in sample]) if sample else np.zeros((1, 1))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            gap = (x**2).sum(1)[:, None] - 2 * x @ center.T + (center**2).sum(1)
            own = gap.argmin(1)
            far = np.linalg.norm(x - center[own], axis=1)
            norm = np.linalg.norm(x, axis=1)
            scale = norm * np.linalg.norm(center[own], axis=1)
            cosine = np.divide((x * center[own]).sum(1), scale, out=np.ones(len(x)), where=scale > 0)
            angle = np.where(norm > 0, np.arccos(np.clip(cosine, -1, 1)), 0) + 1e-7
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), batch.column(1), pa.array(far), pa.array(angle), pa.array(norm)], ["pivot", "id", "v", "far", "angle", "norm"])

    kind = vectors.schema["id"].dataType.simpleString()
    dealt = written(vectors.mapInArrow(near, f"pivot int, id {kind}, v array<double>, far double, angle double, norm double"), "pivots")
    widest = dealt.groupBy("pivot").agg(F.max("far").alias("widest"))  # one row for each pivot
    ring = F.least(F.floor(rings * F.coalesce(F.try_divide("far", "widest"), F.lit(0.0))), F.lit(rings - 1))
    celled = dealt.join(F.broadcast(widest), "pivot").withColumn("cell", (F.col("pivot") * rings + ring).cast("int"))
    told = celled.groupBy("cell", "pivot").agg(F.max("far").alias("far"), F.max("angle").alias("wide"), F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("cell").collect()
    column = lambda name, kind=np.float64: np.array([r[name] for r in told], kind)
    count = column("n", np.int64)
    blocks = -(-count // block)
    sizes = F.broadcast(vectors.sparkSession.createDataFrame([(r.cell, int(b)) for r, b in zip(told, blocks, strict=True)], "cell int, blocks int"))
    rows = celled.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
    return Cells(rows, Outline(column("cell", np.int64), center[column("pivot", np.int64)], column("far"), column("wide"), column("norm"), count, blocks))


def reads(made: Cells, queries: DataFrame, k: int) -> DataFrame:
    """query_id, v, cell, block: the cells that each query reads. Without a column bar the first ones, which hold k rows
    together; with it, the others whose bound reaches it."""
    kind, barred = queries.schema["query_id"].dataType.simpleString(), "bar" in queries.columns
    known = made.outline

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column(1))
            order = np.argsort(-(q @ known.pivot.T), axis=1, kind="stable")
            before = np.cumsum(known.n[order], axis=1) - known.n[order]
            first = np.zeros(order.shape, bool)
            np.put_along_axis(first, order, before < k, 1)
            chosen = ~first & (known.bounds(q) >= batch.column(2).to_numpy()[:, None]) if barred else first
            at, which = np.nonzero(chosen)
            at, which = np.repeat(at, known.blocks[which]), np.repeat(which, known.blocks[which])
            start = np.concatenate([[True], (at[1:] != at[:-1]) | (which[1:] != which[:-1])]) if len(at) else np.zeros(0, bool)
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0)) if len(at) else at
            for i in range(0, len(at), 4096):
                some = pa.array(at[i : i + 4096])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(known.cell[which[i : i + 4096]], pa.int32()), pa.array(place[i : i + 4096], pa.int32())], ["query_id", "v", "cell", "block"])

    fields = ["query_id", F.col("v").cast("array<double>").alias("v"), *(["bar"] if barred else [])]
    return queries.select(*fields).where("v is not null").mapInArrow(run, f"query_id {kind}, v array<double>, cell int, block int")


def compared(made: Cells, asked: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the best k of each block for each query that reads it."""
    q, i = asked.schema["query_id"].dataType.simpleString(), made.rows.schema["id"].dataType.simpleString()
    rows = made.rows.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # as many rows as there are cells
    both = rows.select("cell", "block", F.lit(0).alias("kind"), F.lit(None).cast(q).alias("query_id"), "id", "v").unionByName(asked.select("cell", "block", F.lit(1).alias("kind"), "query_id", F.lit(None).cast(i).alias("id"), "v"))

    def best(ids: pa.Array, x: np.ndarray, asked_ids: pa.Array, asked_v: np.ndarray) -> pa.RecordBatch:
        scores, n = asked_v @ x.T, min(k, len(ids))
        names = np.array(ids.to_pylist())
        if len(ids) > 4 * k:
            keep = np.round(scores, 9) >= np.round(np.partition(scores, -n, axis=1)[:, -n], 9)[:, None] - 1e-9
        else:
            keep = np.ones(scores.shape, bool)
        at, top = [], []
        for a, own in enumerate(keep):
            some = np.flatnonzero(own)
            some = some[np.lexsort((names[some], -np.round(scores[a, some], 9)))[:n]]
            at += [a] * len(some)
            top += some.tolist()
        return pa.RecordBatch.from_arrays([asked_ids.take(pa.array(at, pa.int64())), ids.take(pa.array(top, pa.int64())), pa.array(scores[at, top])], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, x = None, [], None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                part, (cell, block, is_query) = batch.slice(a, b - a), key[a].tolist()
                if (cell, block) != at:
                    at, held, ids, x = (cell, block), [], None, None
                if not is_query:
                    held.append((part.column(4), matrix(part.column(5))))
                    continue
                if ids is None and held:
                    ids, x = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
                if ids is not None:
                    for j in range(0, b - a, 256):
                        some = part.slice(j, 256)
                        yield best(ids, x, some.column(3), matrix(some.column(5)))

    return both.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(run, f"query_id {q}, id {i}, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int, made: Cells | None = None) -> DataFrame:
    """query_id, id, score, rank. vectors: id, v; queries: query_id, v. Ties go to the lesser id.

    made: the cells of vectors, where they are searched more than once. Scores are rounded at the ninth place for ranking.
    """
    made = made or cells(vectors)
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    if not len(made.outline.cell):
        i = vectors.schema["id"].dataType.simpleString()
        return queries.select("query_id", F.lit(None).cast(i).alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    seen = written(compared(made, written(reads(made, queries, k), "reads"), k), "seen")
    bars = seen.withColumn("n", F.row_number().over(by)).where(F.col("n") == k).select("query_id", F.col("score").alias("bar"))
    rest = queries.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    found = seen.unionByName(compared(made, written(reads(made, rest, k), "reads"), k))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
