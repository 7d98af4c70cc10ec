"""Listings with etags, streams of changes, and objects that are streamed, retried and quarantined."""

from __future__ import annotations

import io
import lzma
import os
import random
import re
import subprocess
import sys
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark import cloudpickle

from quillmeter.sources import stores
from quillmeter.streaming import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def tree(tmp_path):
    for key, text in {"a/1.jsonl": "x\n", "a/b/2.jsonl": "yy\n", "c/3.jsonl": "z", "top.txt": "t"}.items():
        (tmp_path / "in" / key).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / key).write_text(text)
    return tmp_path


def test_listing(spark, tree):
    rows = {r["key"]: r for r in stores.listing(spark, str(tree / "in")).collect()}
    assert {k: r["size"] for k, r in rows.items()} == {"a/1.jsonl": 2, "a/b/2.jsonl": 3, "c/3.jsonl": 1, "top.txt": 1}
    assert all(len(r["etag"]) == 40 for r in rows.values()) and stores.listing(spark, str(tree / "in")).rdd.getNumPartitions() == 3
    (tree / "in/c/3.jsonl").write_text("zz")
    assert {r["key"] for r in stores.listing(spark, f"file://{tree}/in").collect() if r["etag"] != rows[r["key"]]["etag"]} == {"c/3.jsonl"}
    assert stores.listing(spark, str(tree / "none")).count() == 0


def test_stream_of_changes(spark, tree):
    spark.dataSource.register(stores.Listing)

    def batch():
        got = []
        frame = spark.readStream.format("object_listing").option("state", str(tree / "state")).load(str(tree / "in"))
        query = frame.writeStream.option("checkpointLocation", str(tree / "check")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend((r["key"], r["change"]) for r in df.collect())).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(got)

    assert batch() == [("a/1.jsonl", "added"), ("a/b/2.jsonl", "added"), ("c/3.jsonl", "added"), ("top.txt", "added")]
    (tree / "in/a/1.jsonl").write_text("other")
    (tree / "in/c/3.jsonl").unlink()
    (tree / "in/c").rmdir()
    (tree / "in/d").mkdir()
    (tree / "in/d/4.jsonl").write_text("n")
    assert batch() == [("a/1.jsonl", "changed"), ("c/3.jsonl", "vanished"), ("d/4.jsonl", "added")]
    assert batch() == []


def test_a_task_that_runs_again_sees_the_same(tree):
    stream = stores.ListingStream(stores.FileStore(str(tree / "in")), str(tree / "state"))
    start, end = stream.initialOffset(), stream.latestOffset()
    first = [sorted(stream.read(p)) for p in stream.partitions(start, end)]
    (tree / "in/a/1.jsonl").unlink()
    assert [sorted(stream.read(p)) for p in stream.partitions(start, end)] == first
    later = stream.latestOffset()
    assert later == {"batch": 2}
    assert [r[4] for p in stream.partitions(end, later) for r in stream.read(p)] == ["vanished"]
    for k in range(3, 6):
        list(map(list, map(stream.read, stream.partitions({"batch": k - 1}, {"batch": k}))))
    stream.commit({"batch": 5})
    assert {n.split("-")[1] for n in stream._names()} == {"4", "5"}


class Bucket:
    """What boto3's client gives."""

    objects = {"p/1": b"one\n", "p/q/2": b"two\n", "root": b"r"}

    def get_paginator(self, name):
        assert name == "list_objects_v2"
        return self

    def paginate(self, Bucket, Prefix, Delimiter=None):
        keys = [k for k in self.objects if k.startswith(Prefix)]
        cut = {k: k[len(Prefix) :].split("/", 1) for k in keys}
        flat = [k for k in keys if not Delimiter or len(cut[k]) == 1]
        for k in flat:  # a page for each object
            yield {"Contents": [{"Key": k, "ETag": f'"etag-{k}"', "Size": len(self.objects[k]), "LastModified": datetime(2026, 1, 1, tzinfo=UTC)}]}
        yield {"CommonPrefixes": [{"Prefix": p} for p in {cut[k][0] + "/" for k in keys if len(cut[k]) > 1}]} if Delimiter else {}

    def get_object(self, Bucket, Key):
        return {"Body": io.BytesIO(self.objects[Key])}


def test_update_of_streamed_objects(spark, tree):
    """The same tables as from whole objects; a damaged object is set aside."""
    line = '{"type":"assistant","timestamp":"2026-01-01T00:00:0%dZ","requestId":"r%d","message":{"role":"assistant","model":"claude-opus-4-7","content":"x","usage":{"input_tokens":5,"output_tokens":7}}}\n'
    (tree / "in/p/s").mkdir(parents=True)
    (tree / "in/p/s/s.jsonl").write_text(line % (1, 1) + "\n" + line % (2, 2))
    (tree / "in/p/s/t.jsonl.xz").write_bytes(lzma.compress((line % (3, 3)).encode()))
    (tree / "in/p/s/u.jsonl.xz").write_bytes(lzma.compress((line % (4, 4)).encode() * 50)[:-20])
    made = [ingest.update(spark, str(tree / "in"), str(tree / f"out{streamed}"), streamed=streamed) for streamed in (False, True)]
    whole, streamed = ([sorted(map(repr, v.read(k).select("file_key", *c).collect())) for k, c in (("files", ["prompt_count"]), ("records", ["line_num", "request_id", "output_tokens"]), ("damaged", []))] for v in made)
    assert whole == streamed and len(streamed[1]) == 3 and "u.jsonl.xz" in streamed[2][0]
    assert ingest.update(spark, str(tree / "in"), str(tree / "outTrue"), streamed=True).number == 1


def test_bucket():
    store = stores.S3Store("b", Bucket)
    assert store.prefixes() == ["", "p/"] and [k for p in store.prefixes() for k, *_ in store.list(p)] == ["root", "p/1", "p/q/2"]
    assert [e for _, e, *_ in store.list("p/")] == ["etag-p/1", "etag-p/q/2"] and store.open("p/1").read() == b"one\n"
    assert stores.store_of("s3a://b/x") == stores.S3Store("b") and stores.store_of("/x") == stores.FileStore("/x")


@pytest.mark.parametrize("seed", range(20))
def test_lines_across_blocks(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(stores, "BLOCK", rng.choice([1, 2, 3, 7, 1 << 20]))
    raw = b"".join(rng.choices([b"a", "é".encode(), "日本".encode(), b"\n", b"\r", b"\r\n", b"\xff", b"\x85", b"  "], k=rng.randrange(60)))
    want = re.split("\r\n|\n|\r", raw.decode("utf-8", "replace"))
    want = want[:-1] if want[-1] == "" else want
    assert list(stores.stream_lines(io.BytesIO(raw), False)) == want
    half = len(raw) // 2
    packed = lzma.compress(raw[:half]) + (b"\0" * 4 if seed % 2 else b"") + lzma.compress(raw[half:])
    assert list(stores.stream_lines(io.BytesIO(packed), True)) == want


class Flaky:
    """Objects whose readers fail some times, after some bytes."""

    def __init__(self, fails):
        self.fails = fails

    def open(self, key):
        left, self.fails[key] = self.fails.get(key, 0), self.fails.get(key, 0) - 1
        body = b"".join(b"%s line %d\n" % (key.encode(), i) for i in range(2000))

        class Reader(io.BytesIO):
            def read(self, n=-1):
                if left > 0 and self.tell() > 9000:
                    raise ConnectionError("dropped")
                return super().read(5000)

        return Reader(lzma.compress(body)[:-30] if key.startswith("cut") and key.endswith("xz") else lzma.compress(body) if key.endswith(".xz") else body)


def test_attempts_and_quarantine(spark):
    keys = ["fine", "twice", "thrice", "cut.xz", "fine.xz"]
    objects = spark.createDataFrame([(k,) for k in keys], "file_key string").coalesce(1)
    got = stores.stream_objects(objects, Flaky({"twice": 2, "thrice": 3}), pauses=(0.0, 0.0), pause=lambda s: None).collect()
    errors = {r["file_key"]: r["error"] for r in got if r["error"]}
    assert set(errors) == {"thrice", "cut.xz"} and errors["thrice"] == "ConnectionError: dropped" and errors["cut.xz"].startswith("EOFError")
    for key in ("fine", "twice", "fine.xz"):
        assert [(r["line_num"], r["value"]) for r in got if r["file_key"] == key] == [(i + 1, f"{key} line {i}") for i in range(2000)]


def test_large_objects_in_little_memory(tmp_path):
    """120 MB of lines from an xz file, in a process that grows by less than 60 MB."""
    path = tmp_path / "big.jsonl.xz"
    with lzma.open(path, "wb", preset=0) as f:
        block = b"".join(b'{"n": %d}\n' % i for i in range(100_000))
        for _ in range(120 * 10**6 // len(block)):
            f.write(block)
    code = f"""
import resource, pyarrow as pa
from quillmeter.sources import stores
from quillmeter.streaming import ingest
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
keys = pa.RecordBatch.from_pydict({{"k": ["big.jsonl.xz"]}})
n = sum(b.num_rows for b in stores._streamed(stores.FileStore({str(tmp_path)!r}), (), None)(iter([keys])))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=300).stdout.split()
    assert int(out[-2]) == 100_000 * (120 * 10**6 // len(block)) and int(out[-1]) < 60
