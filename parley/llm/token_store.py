"""Token ids on disk: one zstandard frame for each document, all with one shared trained dictionary.

A store is a folder with `dictionary.zdict` and shards `part-*.tkz`. A shard is

    magic "TKZ1", width of an id in bytes (u1), SHA-256 of the dictionary (32 bytes),
    the frames one after another, the index, the index's length (u8), magic again,

where the index is a zstandard frame of columns: doc_id (i8), null flag (u1), offset of the frame (u8), ids (u4).
All integers are little-endian. A document is read by its index entry alone, without its neighbours.

Defined cases: a null text has the end id alone; a null doc_id sorts first and is kept; repeated rows are stored
each; an empty table gives a store without shards; other columns are ignored. An id has 2 bytes where the vocabulary
and the end id fit them, else 4; ids that do not fit a width asked for raise an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import encoder

MAGIC = b"TKZ1"
MANIFEST = "partition long, shard long, path string, n_docs long, n_tokens long"


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, width: int, sample_docs: int = 1000, sample_chars: int = 8192, dict_bytes: int = 65536) -> bytes:
    """A dictionary from a bounded sample: rows whose id hash is in a range that holds about sample_docs, at most twice
    as many, and of each a span of sample_chars at a place that its hash gives.

    With too few rows to train on, the sample itself is the dictionary (possibly empty).
    """
    share = max(1, docs.count() // sample_docs)
    picked = docs.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(share)) == 0))
    start = F.pmod(F.xxhash64(text_col), F.greatest(F.length(text_col) - sample_chars + 1, F.lit(1))).cast("int") + 1
    rows = picked.select(F.col(text_col).substr(start, F.lit(sample_chars)).alias("t"), F.xxhash64(id_col, text_col).alias("h")).orderBy("h").limit(2 * sample_docs).collect()
    samples = [_narrow(x, width) for x in encoder(tokenizer_path).encode([r.t for r in rows])]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:dict_bytes]


def _narrow(ids: bytes, width: int) -> bytes:
    if width != 2:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() >= 1 << 16:
        raise ValueError(f"id {wide.max()} does not fit 2 bytes")
    return wide.astype("<u2").tobytes()


@lru_cache(maxsize=4)
def _dictionary(folder: str) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    store, path = shared.filesystem(f"{folder}/dictionary.zdict")
    with store.open_input_stream(path, compression=None) as f:
        raw = f.read()
    return hashlib.sha256(raw).digest(), zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    """Collects the frames of one shard in memory, at most about the size at which the caller rolls over."""

    def __init__(self, folder: str, width: int):
        digest, words = _dictionary(folder)
        self.head = MAGIC + struct.pack("<B", width) + digest
        self.width, self.packer = width, zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True)
        self.frames, self.size, self.tokens = [], len(self.head), 0
        self.index: dict[str, array] = {"id": array("q"), "null": array("B"), "at": array("Q"), "n": array("I")}

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.packer.compress(_narrow(ids, self.width))
        for k, v in (("id", doc_id or 0), ("null", doc_id is None), ("at", self.size), ("n", len(ids) // 4)):
            self.index[k].append(v)
        self.frames.append(frame)
        self.size += len(frame)
        self.tokens += len(ids) // 4

    def write(self, uri: str) -> tuple[str, int, int]:
        n = len(self.frames)
        tail = zstandard.ZstdCompressor(level=3).compress(struct.pack("<Q", n) + b"".join(x.tobytes() for x in self.index.values()))
        shared.write_atomic(uri, [self.head, *self.frames, tail, struct.pack("<Q", len(tail)), MAGIC])
        return uri, n, self.tokens


class ShardReader:
    """Random access to one shard; refuses a dictionary other than the one that the shard names."""

    def __init__(self, uri: str):
        store, path = shared.filesystem(uri)
        self.file = store.open_input_file(path)
        head = self.file.read_at(37, 0)
        digest, words = _dictionary(uri.rsplit("/", 1)[0])
        end = self.file.size()
        length, magic = struct.unpack("<Q4s", self.file.read_at(12, end - 12))
        if head[:4] != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        if head[5:] != digest:
            raise ValueError(f"{uri} was written with another dictionary")
        self.width, self.unpacker = head[4], zstandard.ZstdDecompressor(dict_data=words)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, end - 12 - length))
        n, at, self.columns = struct.unpack_from("<Q", raw)[0], 8, []
        for kind in ("<i8", "u1", "<u8", "<u4"):
            self.columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.ends = np.append(self.columns[2][1:], np.uint64(end - 12 - length)) if n else self.columns[2]

    def __len__(self) -> int:
        return len(self.ends)

    def doc_id(self, i: int) -> int | None:
        return None if self.columns[1][i] else int(self.columns[0][i])

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.columns[2][i]), int(self.ends[i])
        return np.frombuffer(self.unpacker.decompress(self.file.read_at(b - a, a)), f"<u{self.width}").astype("<u4")

    def scan(self, piece: int = 8 << 20) -> Iterator[np.ndarray]:
        """The ids of all documents in order; the file is read in large pieces, not frame by frame."""
        held, begin = b"", 0
        for a, b in zip(self.columns[2].tolist(), self.ends.tolist(), strict=True):
            if b > begin + len(held):
                held, begin = self.file.read_at(min(max(piece, b - a), int(self.ends[-1]) - a), a), a
            yield np.frombuffer(self.unpacker.decompress(held[a - begin : b - begin]), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document by its doc_id, reading its frame only."""
        hits = np.flatnonzero((self.columns[0] == doc_id) & (self.columns[1] == 0))
        return self.ids(int(hits[0])) if len(hits) else None


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20, width: int | None = None) -> DataFrame:
    """Write docs in ascending id_col order; returns the manifest, one row for each shard, already written down.

    Ranges of ids go to tasks of like size; each task writes its shards under temporary names and moves them into
    place, and only the shards of the manifest count, so repeated tasks do no harm.
    """
    spark = docs.sparkSession
    width = width or (2 if max(len(encoder(tokenizer_path).n_bytes) - 1, end_id) < 1 << 16 else 4)
    shared.write_atomic(f"{folder}/dictionary.zdict", [train_dictionary(docs, id_col, text_col, tokenizer_path, width)])
    end = array("I", [end_id]).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, shard = TaskContext.get(), [], None

        def done() -> None:
            made.append((task.partitionId(), len(made), *shard.write(f"{folder}/part-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.tkz")))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 1000):
                for doc_id, found in zip(ids[i : i + 1000], encoder(tokenizer_path).encode([x or "" for x in texts[i : i + 1000]]), strict=True):
                    shard = shard or ShardWriter(folder, width)
                    shard.add(doc_id, found + end)
                    if shard.size >= shard_bytes:
                        done()
                        shard = None
        if shard:
            done()
        yield pa.RecordBatch.from_pylist([dict(zip(("partition", "shard", "path", "n_docs", "n_tokens"), x, strict=True)) for x in made], MANIFEST_ARROW)

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    return shared.stage(ordered.mapInArrow(write, MANIFEST), "manifest")


MANIFEST_ARROW = pa.schema([("partition", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_store(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Each document of the store: doc_id, start (ids of all documents before it), n_tokens, and ids.

    With digest, ids_crc32 stands in place of ids. The running total is over the shards, of which there are few.
    """
    spark: SparkSession = manifest.sparkSession
    order = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, out = ShardReader(path), []
                for i, ids in enumerate(shard.scan()):
                    out.append((shard.doc_id(i), start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids.astype("i4")))
                    start += len(ids)
                    if len(out) == 1000 or i + 1 == len(shard):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []

    schema = DIGEST if digest else READ
    last = "ids_crc32 long" if digest else "ids array<int>"
    return shards.select("path", "start").repartition(n, "path").mapInArrow(read, f"doc_id long, start long, n_tokens long, {last}")
