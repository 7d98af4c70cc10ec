"""WARC archives with one Zstandard frame for each record and a shared dictionary in a leading skippable frame.

An archive is one row (archive, records, content): content is a whole .warc.zst file image of bounded size, so Spark
writes, reads and retries archives like any other table and any store that Spark reaches will do. export() puts them
out as files.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm._store import Store

MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are always stored in full.
LEAST = 100
#: Uncompressed bytes after which a new archive begins, bytes of records a dictionary is trained on, and its size.
ARCHIVE_BYTES, TRAIN_BYTES, DICT_BYTES = 8 << 20, 2 << 20, 32 << 10
#: Rows up to which the table of repeated payloads is broadcast (under 120 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


def repeated_payloads(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(digest, first): payloads of at least LEAST bytes that several rows have, with their smallest non-null key."""
    light = pages.select(F.col(key).alias("_k"), _digest(body).alias("digest"), _size(body).alias("n"))
    found = light.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("_k").alias("first"), F.count("*").alias("n"))
    return found.where("n > 1 and first is not null").select("digest", "first")


def _digest(body: str):
    return F.sha2(F.coalesce(F.col(body), F.lit("")).cast("binary"), 256)


def _size(body: str):
    return F.octet_length(F.coalesce(F.col(body), F.lit("")))


def _record(kind: str, key: str, url: str | None, digest: str, payload: bytes, first: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=_SAFE) if url else f'urn:page:{key}'}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """A .warc.zst file image: the dictionary in a skippable frame, then a frame for each record."""
    sample, size = [], 0
    for r in records:
        if size >= TRAIN_BYTES:
            break
        sample.append(r[: 128 << 10])
        size += len(sample[-1])
    try:
        trained = zstandard.train_dictionary(min(DICT_BYTES, max(256, size // 8)), sample, k=200, d=8)
    except zstandard.ZstdError:  # too few or too short records to train on
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    head = trained.as_bytes()
    return b"".join([struct.pack("<II", MAGIC, len(head)), head, *map(packer.compress, records)])


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of a file image."""
    magic, size = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("not a dictionary-compressed WARC archive")
    trained = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    data = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(memoryview(content)[8 + size :], read_across_frames=True).read()
    pos = 0
    while pos < len(data):
        end = data.index(b"\r\n\r\n", pos)
        head = dict(line.split(": ", 1) for line in data[pos:end].decode().split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        n = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + n]
        pos = end + 8 + n


def _write(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{made:06d}.warc.zst"], "records": [len(held)], "content": [build_archive(held)]}, schema=_ARCHIVE)

        for batch in batches:
            for key, url, body, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (body or "").encode()
                kind = "revisit" if first is not None and first != key else "response"
                held.append(_record(kind, _quoted(key), url, digest, payload, _quoted(first)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return run


def _quoted(key: str | None) -> str:
    return "" if key is None else "=" + quote(key, safe="")


_ARCHIVE = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("content", pa.binary())])


def write_archives(pages: DataFrame, store: Store, key: str = "page_id", url: str = "url", body: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The archives of all rows, as a written table (archive, records, content).

    Of rows with equal payloads of at least 100 bytes, those with the smallest key are responses, the others revisit
    it. A null payload is an empty one, a null key never gets revisits and a null URL is replaced by the record's URN.
    Repeated rows of the smallest key are all responses. Other columns are ignored. Bodies are not shuffled while the
    repeated payloads are few.
    """
    twice = store.table(repeated_payloads(pages, key, body), "repeated")
    few = twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(body).alias("_body"), _digest(body).alias("digest"))
    rows = rows.join(F.broadcast(twice) if few else twice, "digest", "left")
    rows = rows.select(F.col("_key").cast("string"), "_url", "_body", "digest", F.col("first").cast("string"))
    return store.table(rows.mapInArrow(_write(archive_bytes), "archive string, records long, content binary"), "archives", "uncompressed")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = lambda s: unquote(s[11:-1]) if s.startswith("<urn:page:=") else None
    for batch in batches:
        for content in batch.column(0):
            out = [[] for _ in _RECORD.names]
            for head, block in parse_archive(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), head["warc-payload-digest"].removeprefix("sha256:")
                kind, target = head["warc-type"], head["warc-target-uri"]
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record {head['warc-record-id']}")
                row = one(head["warc-record-id"]), target, kind, one(head.get("warc-refers-to", "")), size, digest, payload if kind == "response" else None
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(dict(zip(_RECORD.names, out, strict=True)), schema=_RECORD)


_RECORD = pa.schema([("record_key", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives; digests and lengths of stored payloads are checked, a damaged record raises."""
    return archives.select("content").mapInArrow(_read, "record_key string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file below folder (any URI of a store that pyarrow knows); returns (archive, bytes)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_output_stream(f"{root}/.{name}.part{TaskContext.get().taskAttemptId()}") as out:
                    out.write(content)
                where.move(f"{root}/.{name}.part{TaskContext.get().taskAttemptId()}", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(batch.column(1)).cast(pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(put, "archive string, bytes long")
