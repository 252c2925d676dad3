"""Counting links among the members of groups: payloads meet in pairs of blocks, each shipped once for a block that it meets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def intersections(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The sizes of the intersections of each of xs with each of ys, by products of slices of their 0/1 matrices."""

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        rows, hit = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), common[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return rows[hit][order], at[hit][order]

    def part(rows: np.ndarray, at: np.ndarray, n: int, start: int) -> np.ndarray:
        a, b = np.searchsorted(at, (start, start + width))
        out = np.zeros((n, width), np.float32)
        out[rows[a:b], at[a:b] - start] = 1
        return out

    total = np.zeros((len(xs), len(ys)), np.int64)
    common = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    if len(common):
        (rx, cx), (ry, cy) = places(xs), places(ys)
        for start in range(0, len(common), width):
            total += (part(rx, cx, len(xs), start) @ part(ry, cy, len(ys), start).T).astype(np.int64)
    return total


def count_links(members: DataFrame, payloads: DataFrame, prepare: Callable[[bytes], np.ndarray], percent: int, block: int = 500, block_sum: int = 2_000_000) -> DataFrame:
    """(row, links): for each of the members (row, comp, n, copies), the copies of the others of its comp linked to it.

    Every pair of one comp is compared. A task has the payloads (row, data) of two blocks of a comp and gives counts of
    rows, not pairs, so a dense group of k rows makes k * k / block rows and not k * k.
    """
    by = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_sum)).cast("int").alias("blocks"))
    dealt = members.join(by, "comp").withColumn("k", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    tasks = dealt.select("comp", "row", "copies", "k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).join(payloads, "row")
    tasks = tasks.select("comp", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "row", "copies", "data")

    def counts(at: tuple, sides: tuple[dict, dict]) -> Iterator[tuple[int, int]]:
        x, y = (side or sides[0] for side in sides)
        if at[1] != at[2] and not (sides[0] and sides[1]):
            return
        xs, ys = ([prepare(data) for _, data in side.values()] for side in (x, y))
        sizes = [np.array([len(z) for z in side]) for side in (xs, ys)]
        hit = (100 + percent) * intersections(xs, ys) >= percent * (sizes[0][:, None] + sizes[1][None, :])
        if x is y:
            np.fill_diagonal(hit, False)
        copies = [np.array([c for c, _ in side.values()], np.int64) for side in (x, y)]
        yield from zip(x, (hit @ copies[1]).tolist(), strict=True)
        if x is not y:
            yield from zip(y, (copies[0] @ hit).tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ({}, {})
        for batch in batches:
            found = []
            for comp, i, j, k, row, copies, data in shared.rows_of([batch]):
                if (comp, i, j) != at:
                    if at:
                        found += counts(at, sides)
                    at, sides = (comp, i, j), ({}, {})
                sides[k != i][row] = copies, data
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["row", "links"])
        if at:
            found = list(counts(at, sides))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["row", "links"])

    counted = tasks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(run, "row long, links long")
    return counted.groupBy("row").agg(F.sum("links").alias("links"))
