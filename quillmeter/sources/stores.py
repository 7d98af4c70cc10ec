"""Object stores: listings with etags as a Spark data source, in batches or as a stream of changes, and streamed objects.

A store lists and opens objects where a task runs; only its description travels. `FileStore` is any file system that
pyarrow opens by address, `S3Store` a bucket through boto3, with the store's own etags.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import lzma
import posixpath
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillmeter.sources.transcripts import inside

LISTING = "key string, etag string, size long, last_modified timestamp"
#: Pauses between attempts at an object, in seconds; there is one attempt more.
PAUSES = (0.5, 1.0)
#: Bytes of an object that are read at once, and lines in a batch.
BLOCK, LINES = 1 << 20, 5_000


@dataclass(frozen=True)
class FileStore:
    """A folder of a file system, by its address; an etag changes with time of modification and size."""

    root: str

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{posixpath.abspath(self.root)}")

    def prefixes(self) -> list[str]:
        """The folders right below the root, with a slash, and the empty prefix for the objects beside them."""
        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return ["", *sorted(f"{f.base_name}/" for f in found if f.type == fs.FileType.Directory)]

    def list(self, prefix: str) -> Iterator[tuple[str, str, int, datetime]]:
        """(key, etag, size, last_modified) of the objects below a prefix; below the empty one only those in no folder."""
        files, root = self._open()
        for f in files.get_file_info(fs.FileSelector(posixpath.join(root, prefix), allow_not_found=True, recursive=bool(prefix))):
            if f.type == fs.FileType.File:
                yield posixpath.relpath(f.path, root), hashlib.sha1(f"{f.mtime_ns}:{f.size}".encode()).hexdigest(), f.size, f.mtime

    def open(self, key: str) -> BinaryIO:
        files, root = self._open()
        return files.open_input_stream(inside(root, key), compression=None)


@dataclass(frozen=True)
class S3Store:
    """A bucket, by boto3, which is imported where it is used. client makes another client, as in tests."""

    bucket: str
    client: Callable | None = None

    def _client(self):
        if self.client:
            return self.client()
        import boto3

        return boto3.client("s3")

    def prefixes(self) -> list[str]:
        pages = self._client().get_paginator("list_objects_v2").paginate(Bucket=self.bucket, Prefix="", Delimiter="/")
        return ["", *sorted(p["Prefix"] for page in pages for p in page.get("CommonPrefixes", []))]

    def list(self, prefix: str) -> Iterator[tuple[str, str, int, datetime]]:
        level = {} if prefix else {"Delimiter": "/"}
        for page in self._client().get_paginator("list_objects_v2").paginate(Bucket=self.bucket, Prefix=prefix, **level):
            for o in page.get("Contents", []):
                yield o["Key"], str(o["ETag"]).strip('"'), int(o["Size"]), o["LastModified"]

    def open(self, key: str) -> BinaryIO:
        return self._client().get_object(Bucket=self.bucket, Key=key)["Body"]


def store_of(root: str) -> FileStore | S3Store:
    """The store of an address: s3://bucket and s3a://bucket by boto3, all others as file systems."""
    scheme, _, rest = root.partition("://")
    return S3Store(rest.split("/", 1)[0]) if scheme in ("s3", "s3a") else FileStore(root)


@dataclass
class Prefix(InputPartition):
    prefix: str
    start: int = 0
    end: int = 0


class Listing(DataSource):
    """`spark.read.format("object_listing").load(root)`: (key, etag, size, last_modified) of all objects below a root, a
    partition for each folder right below it.

    `spark.readStream.format("object_listing").option("state", folder).load(root)` has a further column change: added,
    changed or vanished. Each batch compares the objects with those of the last one. A batch is a number; what it saw is
    kept in the state folder, a file for each prefix, so a task or query that runs again gives the same rows, and no
    offset, driver or executor holds a listing but that of one prefix. The folder must be shared, like a checkpoint.
    """

    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return LISTING + (", change string" if "state" in self.options else "")

    def store(self):
        return store_of(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.store())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStream(self.store(), self.options["state"])


class ListingReader(DataSourceReader):
    def __init__(self, store):
        self.store = store

    def partitions(self) -> Sequence[InputPartition]:
        return [Prefix(p) for p in self.store.prefixes()]

    def read(self, partition: Prefix) -> Iterator[tuple]:
        yield from self.store.list(partition.prefix)


class ListingStream(DataSourceStreamReader):
    def __init__(self, store, state: str):
        self.store, self.state = store, state

    def _state(self) -> tuple[fs.FileSystem, str]:
        files, root = FileStore(self.state)._open()
        files.create_dir(root, recursive=True)
        return files, root

    def _names(self) -> list[str]:
        files, root = self._state()
        return [f.base_name for f in files.get_file_info(fs.FileSelector(root))]

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """A new batch for each trigger; those that were planned are marked in the state."""
        return {"batch": max((int(n[5:]) for n in self._names() if n.startswith("plan-")), default=0) + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files, root = self._state()
        with files.open_output_stream(f"{root}/plan-{end['batch']}") as out:
            out.write(b"\n")
        seen = {json.loads(bytes.fromhex(n.split("-")[2])) for n in self._names() if n.startswith(f"seen-{start['batch']}-")}
        return [Prefix(p, start["batch"], end["batch"]) for p in sorted(seen | set(self.store.prefixes()))]

    def _seen(self, batch: int, prefix: str) -> dict[str, list] | None:
        files, root = self._state()
        path = f"{root}/seen-{batch}-{json.dumps(prefix).encode().hex()}"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(path) as f:
            return {row[0]: row for row in map(json.loads, f.read().splitlines())}

    def read(self, partition: Prefix) -> Iterator[tuple]:
        before = self._seen(partition.start, partition.prefix) or {}
        now = self._seen(partition.end, partition.prefix)
        if now is None:
            now = {k: [k, etag, size, at.timestamp()] for k, etag, size, at in self.store.list(partition.prefix)}
            files, root = self._state()
            path = f"{root}/seen-{partition.end}-{json.dumps(partition.prefix).encode().hex()}"
            with files.open_output_stream(f"{path}.part") as out:
                out.write("\n".join(map(json.dumps, now.values())).encode())
            files.move(f"{path}.part", path)
        for key, (_, etag, size, at) in now.items():
            if key not in before or before[key][1] != etag:
                yield key, etag, size, datetime.fromtimestamp(at, UTC), "changed" if key in before else "added"
        for key in before.keys() - now.keys():
            _, etag, size, at = before[key]
            yield key, etag, size, datetime.fromtimestamp(at, UTC), "vanished"

    def commit(self, end: dict) -> None:
        """Forgets what batches before the last saw."""
        files, root = self._state()
        for name in self._names():
            if int(name.split("-")[1].split(".")[0]) < end["batch"] - 1:
                files.delete_file(f"{root}/{name}")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """The objects below a root, by the data source."""
    spark.dataSource.register(Listing)
    return spark.read.format("object_listing").load(root)


def _plain(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of an xz file, a block at a time; files of several streams are one."""
    unpack = lzma.LZMADecompressor()
    for block in blocks:
        while block:
            if unpack.eof:
                block = block.lstrip(b"\0")  # padding between streams
                if not block:
                    break
                unpack = lzma.LZMADecompressor()
            yield unpack.decompress(block, BLOCK)
            while not unpack.eof and not unpack.needs_input:
                yield unpack.decompress(b"", BLOCK)
            block = unpack.unused_data if unpack.eof else b""
    if not unpack.eof:
        raise EOFError("the object ends within its compressed content")


def stream_lines(source: BinaryIO, packed: bool) -> Iterator[str]:
    """The lines of an object, blank ones included, holding a block and the line that it ends in."""
    blocks = iter(lambda: source.read(BLOCK), b"")
    text, rest = codecs.getincrementaldecoder("utf-8")("replace"), []
    for block in _plain(blocks) if packed else blocks:
        now = text.decode(block)
        if rest and rest[-1].endswith("\r") and now:  # \r\n may be cut in two
            now = rest.pop() + now
        held, tail = (now[:-1], "\r") if now.endswith("\r") else (now, "")
        parts = re.split("\r\n|\n|\r", held)
        if len(parts) > 1:
            yield "".join([*rest, parts[0]])
            yield from parts[1:-1]
            rest = []
        rest += [p for p in (parts[-1] + tail,) if p]
    last = "".join([*rest, text.decode(b"", True)])
    if last:
        yield last.removesuffix("\r")


def _streamed(store, pauses: tuple[float, ...], pause: Callable[[float], None]):
    """(file_key, line_num, value, error) of objects. A reader that fails is opened again, and lines that it gave already
    are passed over; after the last attempt, and at once if its content is damaged, the object gets a row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            keys, numbers, values, errors = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=["file_key", "line_num", "value", "error"])

        for batch in batches:
            for key in batch.column(0).to_pylist():
                given, size = 0, 0
                for attempt in range(len(pauses) + 1):
                    try:
                        source = store.open(key)
                        try:
                            for number, line in enumerate(stream_lines(source, key.endswith(".xz")), 1):
                                if number > given:
                                    given, size = number, size + len(line)
                                    if line.strip():
                                        rows.append((key, number, line, None))
                                    if len(rows) >= LINES or size >= 16 * BLOCK:
                                        size = 0
                                        if rows:
                                            yield out()
                        finally:
                            source.close()
                        break
                    except (lzma.LZMAError, EOFError) as e:
                        rows.append((key, None, None, f"{type(e).__name__}: {e}"))
                        break
                    except Exception as e:  # a connection: the object may be read later
                        if attempt == len(pauses):
                            rows.append((key, None, None, f"{type(e).__name__}: {e}"))
                        else:
                            pause(pauses[attempt])
            if rows:
                yield out()

    return run


def stream_objects(objects: DataFrame, store, key: str = "file_key", pauses: tuple[float, ...] = PAUSES, pause: Callable[[float], None] = time.sleep, tasks: int | None = None) -> DataFrame:
    """(file_key, line_num, value, error): the lines of the objects with some keys that aren't blank, numbered from 1 with
    blank ones counted; a damaged or unreachable object has a row with an error, after the lines before the fault.

    Objects are opened where they are read and never held whole. Callers leave out the lines of objects with an error. The
    keys are dealt out to tasks, of which a few keys get one each.
    """
    tasks = tasks or 8 * objects.sparkSession.sparkContext.defaultParallelism
    return objects.select(key).repartition(tasks, key).mapInArrow(_streamed(store, pauses, pause), "file_key string, line_num int, value string, error string")
