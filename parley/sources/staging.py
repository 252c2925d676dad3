"""Tables written down in the shared folder of the cluster, to cut lineage so that lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_open: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it, else the warehouse; a temporary folder only if there is one machine.

    A warehouse in a folder of each machine is none that a cluster shares.
    """
    named, alone = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master.startswith("local")
    if not named and not alone:
        named = spark.conf.get("spark.sql.warehouse.dir")
        if named.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not named and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="parley-"))
    return (named or _own[0]).rstrip("/")


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """df, written down and read back. Inside scratch() the table goes at its end; a lasting one at the end of the scratch() around it."""
    path = f"{shared_dir(df.sparkSession)}/parley/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    around = _open[:-1] if lasting else _open
    if around:
        around[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """What is written inside is deleted at the end, but for lasting tables. Nothing that reads it may be used afterwards."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def lasting() -> Iterator[None]:
    """What is written inside outlives the scratch() around it."""
    held = _open[:]
    _open.clear()
    try:
        yield
    finally:
        _open[:] = held


def bounded(staged: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only if the written table's counted rows fit limit_bytes; otherwise leave a shuffle join."""
    return F.broadcast(staged) if staged.count() * row_bytes <= limit_bytes else staged


def spread(df: DataFrame, rows: int = 20_000, *keys: str) -> DataFrame:
    """df dealt out (by keys) to all cores, and to as many tasks as hold `rows` rows each: for rows that are more work than bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)
