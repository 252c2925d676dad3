"""Choosing and verifying pairs of rows, in proportion to the rows of a group and not to its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def by_pivot(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each member with the best pivot of its buckets that is of another component.

    members: token (the bucket), row, n (size), weight, comp. A bucket offers its member of most weight and its best
    of any other component; members whose sizes rule the similarity out are not paired.
    """
    best = F.max(F.struct("weight", (-F.col("row")).alias("minus"), "n", "comp"))
    first = members.groupBy("token").agg(best.alias("p"))
    second = members.join(first, "token").where("comp <> p.comp").groupBy("token").agg(best.alias("q"))
    offers = first.join(second, "token", "left")
    fits = F.expr(f"100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    picked = members.join(offers, "token").select("row", "n", F.expr("case when comp <> p.comp then p else q end").alias("p")).where(F.col("p").isNotNull() & fits)
    return picked.groupBy("row").agg(F.max("p").alias("p")).select(F.col("row").alias("a"), (-F.col("p.minus")).alias("b"))


def verify(pairs: DataFrame, payloads: DataFrame, prepare: Callable[[bytes], object], linked: Callable[[object, object], bool], block: int = 500) -> DataFrame:
    """The pairs (a, b) whose payloads (row, data) are linked.

    The many partners of one b go to several tasks, each with b's payload once; a task holds one b at a time.
    """
    salts = shared.stage(pairs.groupBy("b").agg(F.ceil(F.count("*") / block).cast("int").alias("salts")), "salts")
    members = pairs.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
    members = members.join(payloads.withColumnRenamed("row", "a"), "a").select("b", "salt", "a", "data")
    pivots = salts.join(payloads.withColumnRenamed("row", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot = None, None
        for batch in batches:
            found = []
            for b, _, a, data in shared.rows_of([batch]):
                if a is None:
                    at, pivot = b, prepare(data)
                elif b == at and linked(prepare(data), pivot):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return members.unionByName(pivots).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first()).mapInArrow(run, "a long, b long")
