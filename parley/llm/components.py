"""Connected components of a table of links by alternating large-star and small-star steps.

Every step is an aggregation of the least neighbour by node and a join back, so no node's neighbours are gathered,
however many they are; each round is written down in the shared folder. The rounds grow with the logarithm of the
number of nodes; a graph of stars needs one or two. Rounds go on while there are more than `limit` edges; what is
left, counted first and of bounded size, is ended by one union-find on an executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) that come."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = find(u), find(v)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", limit: int = 1 << 18) -> DataFrame:
    """(node, root), written down, for each node that a link names: root is the least node of its component."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, mark = shared.stage(edges, "edges"), None
    while True:
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found[0] <= limit or found == mark:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            out = shared.stage(stars if found[0] > limit else edges.coalesce(1).mapInArrow(union_find, "node long, root long"), "components")
            shared.release(edges)
            return out
        mark = found
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared.stage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        down = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, shared.stage(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        shared.release(last, large)
