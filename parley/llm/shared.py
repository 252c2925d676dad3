"""Shared-folder staging, size-checked broadcasts and file access for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, the warehouse, which all machines share; a temporary folder only if there is one machine.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        named = spark.conf.get("spark.sql.warehouse.dir")
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="parley-shared-")
    return _own_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/parley/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    return _staged(df, name)


def stage_texts(df: DataFrame, name: str) -> DataFrame:
    """stage() at the lightest level of compression: a third less time to write texts, which take an eighth more space."""
    return _staged(df, name, **{"parquet.compression.codec.zstd.level": "1"})


def _staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and let Spark's cleaner drop the shuffle files behind them.

    The cleaner acts when the driver's collector finds a shuffle unreachable; without a collection now and then, the
    files of every step of a long operator stay on the executors' disks until its end.
    """
    for df in staged:
        jvm, path = df.sparkSession._jvm, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def free_name(df: DataFrame, base: str) -> str:
    """base, or a longer name, that no column of df has in any letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    """The rows of the batches as tuples, of which so many at most are Python objects at a time, whatever a batch holds."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, size).columns), strict=True)


def map_rows(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for a run that takes columns by position, whatever their names (a dot in one is no path)."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def maybe_broadcast(staged: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only if the staged table's counted rows fit limit_bytes; otherwise leave a shuffle join."""
    return F.broadcast(staged) if staged.count() * row_bytes <= limit_bytes else staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """(filesystem, path) of a URI in the shared store, for executors that write or read binary files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_atomic(uri: str, chunks) -> int:
    """Write the chunks to a temporary name, then move it into place: a lost or repeated task leaves no torn file."""
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with store.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, path)
    return size
