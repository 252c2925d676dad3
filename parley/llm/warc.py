"""WARC archives: writing with revisits, segments and chunked framing; reading with segment reassembly.

Writing. Each row gives one record. Of rows with equal payloads of at least min_bytes bytes, the one with the least
key is a response and the others are revisits of it, found by grouping digests alone. A record block longer than
segment_bytes is parted: the record itself is segment 1 and continuation records follow, the last with the total
length. HTTP bodies of responses are written in chunked transfer framing. Each record is a gzip member of its own;
files are written under temporary names and moved into place, and only those of the manifest count.

Reading. Records are parsed file by file. Segmented records alone are shuffled: by the identifier of their origin,
ordered by segment number, checked for gaps and against the total length, and joined; then the HTTP block is decoded
and the payload checked against its digest. A record that fails a check is returned with its fault in `error` and
without a payload.

Defined cases: a null payload is empty; a null key is written as such and is never the origin of a revisit if any
key of its group is not null; rows that repeat key and payload are all responses if their key is the least; an empty
table gives no files and no rows; other columns are ignored; a null url is written as an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

OK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = "record_type string, key string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary, error string"
SEGMENT = "origin string, number long, total long, record_type string, key string, refers_to string, url string, declared string, block binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def unchunk(data: bytes) -> bytes:
    """The body in chunked framing; chunk extensions and trailers are passed over. Raises ValueError on bad framing."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(data[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if size < 0 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(data[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": DATE} | {k: v for k, v in fields.items() if v is not None} | {"Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records_of(key, url: str, payload: bytes, refers_to, refers_url, record_id: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    safe = "!#$%&'()*+,/:;=?@[]~"
    fields = {"WARC-Target-URI": quote(url, safe=safe), "X-Record-Key": key, "WARC-Payload-Digest": "sha1:" + base32_sha1(payload)}
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": quote(refers_url or "", safe=safe), "X-Refers-To-Key": refers_to, "Content-Type": "application/http; msgtype=response"}
        yield record("revisit", record_id, fields, OK + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = OK + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    fields["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment_bytes:
        yield record("response", record_id, fields, block)
        return
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record("response", record_id, fields | {"WARC-Segment-Number": 1}, cuts[0])
    for i, cut in enumerate(cuts[1:], 2):
        total = len(block) if i == len(cuts) else None
        own = {"WARC-Segment-Origin-ID": record_id, "WARC-Segment-Number": i, "WARC-Segment-Total-Length": total}
        yield record("continuation", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}/{i}')}>", own, cut)


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, file_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives; returns their manifest, already written down."""
    base = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    alike = base.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.min_by("url", "key").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = shared.maybe_broadcast(shared.stage(alike, "digests"), 256)
    joined = base.join(known, "digest", "left").select("key", "url", "payload", F.expr("case when first <=> key then null else first end").alias("refers_to"), "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held, size, n = TaskContext.get(), [], [], 0, 0
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"

        def done() -> None:
            uri = f"{name}-{len(made):04d}.warc.gz"
            made.append({"path": uri, "records": len(held), "bytes": shared.write_atomic(uri, held)})
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}')}>"
                for raw in records_of(*row, record_id, segment_bytes, chunk_bytes):
                    held.append(member(raw))
                    size += len(held[-1])
                if size >= file_bytes:
                    done()
                    size = 0
        if held:
            done()
        yield pa.RecordBatch.from_pylist(made, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return shared.stage(joined.mapInArrow(write, MANIFEST), "warc-manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive of gzip members, read forward in bounded pieces."""
    unpack, data, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal unpack
        raw = unpack.unused_data or stream.read(1 << 20)
        if not raw:
            return False
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        data.extend(unpack.decompress(raw))
        return True

    while True:
        while (end := data.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if data[at:].strip():
                    raise ValueError("the archive ends inside a record")
                return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at, length = end + 4, int(head["content-length"])
        while len(data) < at + length + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield head, bytes(data[at : at + length])
        at += length + 4
        if at > 1 << 20 or at == len(data):
            del data[:at]
            at = 0


def decode(kind: str, block: bytes, declared: str | None) -> tuple[int | None, str | None, bytes | None, str | None]:
    """(payload bytes, digest, payload, error) of an HTTP block; a revisit has the length and digest it declares."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    wanted = declared.split(":", 1)[-1] if declared else None
    if kind == "revisit":
        return int(fields.get(b"content-length", 0)), wanted, None, None
    try:
        payload = unchunk(body) if b"chunked" in fields.get(b"transfer-encoding", b"").lower() else body
    except ValueError as e:
        return None, None, None, str(e)
    digest = base32_sha1(payload)
    return (None, None, None, "the payload's digest differs") if wanted and wanted != digest else (len(payload), digest, payload, None)


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """Blocks in the order of their numbers as one, or what is wrong with them. A number seen twice counts once."""
    blocks, total = {}, None
    for number, declared, block in parts:
        blocks.setdefault(number, block)
        total = declared if declared is not None else total
    if sorted(blocks) != list(range(1, len(blocks) + 1)):
        return None, "a segment is missing"
    block = b"".join(blocks[i] for i in sorted(blocks))
    if total is None:
        return None, "the last segment is missing"
    return (block, None) if len(block) == total else (None, "the total length differs")


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each response, revisit and other first record: see RECORD. Revisits have no payload of their own."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole_schema, segment_schema = (to_arrow_schema(StructType.fromDDL(x)) for x in (RECORD, SEGMENT))

    def told(kind, key, refers, url, block, declared, error=None):
        n, digest, payload, fault = (None, None, None, error) if error else decode(kind, block, declared)
        return kind, key, refers, url, n, digest, payload if with_payload else None, fault

    def flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if len(held) >= 1000 or size >= 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = shared.filesystem(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in parse(stream):
                        kind = head["warc-type"]
                        number = head.get("warc-segment-number")
                        yield kind, head, number, (kind, head.get("x-record-key"), head.get("x-refers-to-key"), head.get("warc-target-uri")), block

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from flushed((told(*row, block, head.get("warc-payload-digest")) for kind, head, number, row, block in records(batches) if number is None), whole_schema)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for kind, head, number, row, block in records(batches):
                if number is not None:
                    total = head.get("warc-segment-total-length")
                    yield head.get("warc-segment-origin-id") or head["warc-record-id"], int(number), int(total) if total else None, *row, head.get("warc-payload-digest"), block

        yield from flushed(rows(), segment_schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, parts, first = None, [], None

            def closed():
                block, error = join_segments(parts)
                kind, key, refers, url, declared = first or (None,) * 5
                return told(kind, key, refers, url, block, declared, error)

            for batch in batches:
                for origin, number, total, kind, key, refers, url, declared, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if origin != at:
                        if parts:
                            yield closed()
                        at, parts, first = origin, [], None
                    if number == 1:
                        first = (kind, key, refers, url, declared)
                    parts.append((number, total, block))
            if parts:
                yield closed()

        yield from flushed(rows(), whole_schema)

    files = manifest.select("path").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    parted = files.mapInArrow(segments, SEGMENT).repartition("origin").sortWithinPartitions("origin", "number")
    return files.mapInArrow(whole, RECORD).unionByName(parted.mapInArrow(joined, RECORD))
