"""Approximate nearest neighbours by cosine: inverted file, product-quantised residuals, exact reranking.

fit() takes a bounded sample (rows of a range of id hashes, 16 for each list and 8192 at least) for the coarse
centroids and the codebooks; every row is indexed. There are about sqrt(N) lists, at most `max_lists`, so lists grow
no faster than their number. index() gives each vector its list and the codes of its residual. A query searches the
model's nprobe lists nearest to it, so many as hold the share `recall` of the nearest neighbours within the sample, in
two passes over the codes:

1. Asymmetric distances (tables of the query's residual against the codebooks) of all vectors in those lists are
   counted in bins of a fixed width. Summed over all its lists, they say below which distance a query has `rerank`
   candidates.
2. The vectors up to that distance, and they alone, are compared by the exact cosine in double precision.

So exact comparisons are about `rerank` for each query, however large the lists are, while candidates of equal
distance (copies) are all compared. Large lists are dealt out in blocks, each a task of its own, so a list that holds
a third of all vectors is split.

Ties go to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as queries nor
as candidates; a query meets the vectors of its own dimension, each dimension being searched apart (a model that is
given has one dimension, and only that takes part); repeated rows are candidates each, except those with the query's
own id; fewer candidates than k give fewer rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Model:
    """coarse: lists by dim; books: parts by codes by dim / parts; nprobe: lists that a query searches."""

    coarse: np.ndarray
    books: np.ndarray
    nprobe: int = 1

    def nearest_lists(self, x: np.ndarray, k: int) -> np.ndarray:
        far = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        k = min(k, len(self.coarse))
        best = np.argpartition(far, k - 1, axis=1)[:, :k]
        return np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)

    def codes(self, residual: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        out = np.empty((len(residual), parts), np.uint8)
        for p in range(parts):
            x, book = residual[:, p * width : (p + 1) * width], self.books[p]
            out[:, p] = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
        return out

    def distances(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of residuals of queries to codes, by a table of each part for each query."""
        parts, _, width = self.books.shape
        far = np.zeros((len(residuals), len(codes)))
        for p in range(parts):
            x, book = residuals[:, p * width : (p + 1) * width], self.books[p]
            table = (x**2).sum(1)[:, None] - 2 * x @ book.T + (book**2).sum(1)
            far += np.maximum(table, 0)[:, codes[:, p]]
        return far


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((centers**2).sum(1) - 2 * x[i : i + 4096] @ centers.T).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
    return centers


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 or more and below 1: exact, and no square of it leaves the range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(sound & F.col("id").isNotNull())


def probes_needed(model: Model, x: np.ndarray, recall: float, k: int = 5, queries: int = 256) -> int:
    """How many lists hold the share `recall` of the k nearest of some of x among all of x."""
    asked = x[:queries]
    near = x @ asked.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-near, axis=0, kind="stable")[: min(k, len(x) - 1)].T
    place = np.argsort(model.nearest_lists(asked, len(model.coarse)), axis=1)
    own = model.nearest_lists(x, 1)[:, 0]
    found = np.take_along_axis(place, own[best], 1)
    return int(np.quantile(found, recall, method="higher")) + 1 if found.size else 1


def fit(vectors: DataFrame, max_lists: int = 4096, parts: int = 16, codes: int = 256, recall: float = 0.96) -> Model | None:
    n = vectors.count()
    lists = min(max_lists, math.isqrt(n))
    sample = max(8192, 16 * lists)
    share = max(1, n // sample)
    rows = vectors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("v").limit(2 * sample).collect() or vectors.select("v").limit(sample).collect()
    if not rows:
        return None
    x = unit(np.array([r.v for r in rows]))
    coarse = kmeans(x, lists)
    dim = x.shape[1]
    model = Model(coarse, np.zeros((1, 1, dim)))
    residual = x - coarse[model.nearest_lists(x, 1)[:, 0]]
    while dim % parts:
        parts -= 1
    width = dim // parts
    books = [kmeans(residual[:, p * width : (p + 1) * width], codes, seed=p) for p in range(parts)]
    size = max(map(len, books))
    return Model(coarse, np.stack([np.concatenate([b, np.repeat(b[-1:], size - len(b), 0)]) for b in books]), min(lists, probes_needed(model, x, recall)))


def index(vectors: DataFrame, model: Model) -> DataFrame:
    """id, v, list, codes for every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.array(batch.column("v").to_pylist()))
            own = model.nearest_lists(x, 1)[:, 0]
            codes = model.codes(x - model.coarse[own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "list", "codes"])

    return vectors.mapInArrow(run, "id long, v array<double>, list int, codes binary")


def probes(queries: DataFrame, model: Model, nprobe: int) -> DataFrame:
    """id, v, list: each query once for each list that it searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = model.nearest_lists(unit(np.array(batch.column("v").to_pylist())), nprobe)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(lists.tolist(), pa.list_(pa.int32()))], ["id", "v", "lists"])

    return queries.mapInArrow(run, "id long, v array<double>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors give equal numbers wherever they stand."""
    q, x = scaled(q), scaled(x)
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


#: Bins for each unit of squared distance.
BINS = 128


class Block:
    """The rows of one block of a list, as they come, and the distances of a query to them."""

    def __init__(self, model: Model, at: tuple[int, int]):
        self.model, self.at, self.held, self.ids, self.rows, self.codes = model, at, [], None, None, None

    def close(self) -> None:
        if self.ids is None:
            self.ids = np.array([r[0] for r in self.held], np.int64)
            self.rows = np.array([r[1] for r in self.held]) if self.held and self.held[0][1] is not None else None
            self.codes = np.frombuffer(b"".join(r[2] for r in self.held), np.uint8).reshape(len(self.held), -1)

    def bins(self, query_ids: list[int], q: np.ndarray) -> np.ndarray:
        """For each query the bin of each row's distance; a negative one for rows with the query's own id."""
        self.close()
        residuals = unit(q) - self.model.coarse[self.at[0]]
        far = (self.model.distances(residuals, self.codes) * BINS).astype(np.int64)
        far[np.array(query_ids)[:, None] == self.ids] = -1
        return far


def in_blocks(rows: DataFrame, model: Model, found: Callable[[np.ndarray, Block, tuple], Iterator[tuple]], schema: pa.Schema, ddl: str, together: int = 64) -> DataFrame:
    """What found gives for each query and each block that it searches. rows: list, block, asked, id, v, codes, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, out = None, [], []

        def ask() -> None:
            if waiting and block.held:
                bins = block.bins([r[0] for r in waiting], np.array([r[1] for r in waiting]))
                for row, own in zip(waiting, bins, strict=True):
                    out.extend(found(own, block, row))
            waiting.clear()

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for lst, blk, asked, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None or block.at != (lst, blk):
                    ask()
                    block = Block(model, (lst, blk))
                if not asked:
                    block.held.append(rest)
                else:
                    waiting.append(rest)
                    if len(waiting) >= together:
                        ask()
            if len(out) > 10_000:
                yield told()
        ask()
        yield told()

    return rows.repartition("list", "block").sortWithinPartitions("list", "block", "asked").mapInArrow(run, ddl)


def best_of_blocks(sound: DataFrame, is_query: Column, k: int, rerank: int, block: int, model: Model) -> DataFrame:
    """query_id, id, score: the best k of each list block that a query searches, all vectors being of the model's dimension."""
    stored = shared.stage(index(sound, model), "index")
    sizes = stored.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # one row for each list
    dealt = stored.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = probes(sound.where(is_query), model, model.nprobe).join(F.broadcast(sizes), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asked"), "id", "v", F.lit(None).cast("binary").alias("codes"))

    def counted(bins: np.ndarray, block: Block, row: tuple) -> Iterator[tuple]:
        """The counts of the nearest bins of a block, as far as it takes to reach `rerank` there."""
        bins, n = np.unique(bins[bins >= 0], return_counts=True)
        last = int(np.searchsorted(np.cumsum(n), rerank)) + 1
        yield from zip([row[0]] * last, bins[:last].tolist(), n[:last].tolist(), strict=False)

    def compared(bins: np.ndarray, block: Block, row: tuple) -> Iterator[tuple]:
        best = np.flatnonzero((bins >= 0) & (bins <= row[3]))
        if len(best):
            score, ids = cosines(np.array(row[1]), block.rows[best]), block.ids[best]
            for j in np.lexsort((ids, -score))[:k]:
                yield row[0], int(ids[j]), float(score[j]), len(best)

    codes_only = dealt.select("list", "block", F.lit(0).alias("asked"), "id", F.lit(None).cast("array<double>").alias("v"), "codes")
    counts = in_blocks(codes_only.unionByName(asked), model, counted, pa.schema([("id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())]), "id long, bin long, n long")
    nearer = Window.partitionBy("id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.groupBy("id", "bin").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0)))
    cuts = shared.stage(counts.where(F.col("before") < rerank).groupBy("id").agg(F.max("bin").alias("cut")), "cuts")
    asked = asked.join(shared.maybe_broadcast(cuts, 24), "id").select("list", "block", "asked", "id", "v", "codes", "cut")
    both = dealt.select("list", "block", F.lit(0).alias("asked"), "id", "v", "codes", F.lit(None).cast("long").alias("cut")).unionByName(asked)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("compared", pa.int64())])
    return in_blocks(both, model, compared, schema, "query_id long, id long, score double, compared long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = 200, block: int = 4000, model: Model | None = None) -> DataFrame:
    """query_id, rank, id, score. is_query is over the column id."""
    spark = vectors.sparkSession
    sound = shared.stage(usable(vectors, id_col, vector_col), "vectors")
    if model:
        parts = [(sound.where(F.size("v") == model.coarse.shape[1]), model)]
    else:
        asked = F.max(F.coalesce(is_query, F.lit(False)).cast("int")).alias("asked")
        dims = sound.groupBy(F.size("v").alias("dim")).agg(asked).where("asked = 1").orderBy("dim").collect()
        parts = [(x, fit(x)) for x in (sound.where(F.size("v") == r.dim) for r in dims)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    found = reduce(DataFrame.unionByName, [best_of_blocks(x, is_query, k, rerank, block, m) for x, m in parts])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
