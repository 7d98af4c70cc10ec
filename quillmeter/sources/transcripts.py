"""Transcript objects: listing, transparent xz, lines.

Keys are project/session/.../name.jsonl[.xz] below the root; shorter keys are no transcripts.
"""

from __future__ import annotations

import lzma
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.sources.tables import exists

_LISTING = "path string, modificationTime timestamp, length long, content binary"


def inside(root: str, key: str) -> str:
    """root/key, or a ValueError if the key leads out of the root."""
    if key.startswith("/") or ".." in key.split("/") or "\0" in key:
        raise ValueError(f"key leaves the root: {key!r}")
    return posixpath.join(root.rstrip("/"), key)


def objects(spark: SparkSession, root: str, keys: list[str] | None = None, etags: DataFrame | None = None) -> DataFrame:
    """(key, etag, size, last_modified, content) of all files below a folder or bucket, or of those with given keys only;
    unread content costs nothing.

    The etag changes with size and time of modification; etags (key, etag) are a store's own, which come first.
    """
    load = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema(_LISTING)
    files = load.load([inside(root, k) for k in keys] if keys else root)
    name = root.split("://")[-1].strip("/")
    key = F.regexp_replace(F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), f"{name}/", -1), "^/+", "")
    etag = F.sha1(F.concat_ws(":", F.unix_micros("modificationTime"), F.col("length")).cast("binary"))
    out = files.select(key.alias("key"), etag.alias("etag"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")
    if etags is None:
        return out
    own = etags.groupBy("key").agg(F.max("etag").alias("own"))
    return out.join(own, "key", "left").withColumn("etag", F.coalesce("own", "etag")).drop("own").select("key", "etag", "size", "last_modified", "content")


def transcripts(listing: DataFrame) -> DataFrame:
    """The listed objects that are transcripts, with file_key, project_id, session_id and is_main."""
    parts = F.split("key", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl(\.xz)?$", "")
    found = listing.where(F.col("key").rlike(r"\.jsonl(\.xz)?$") & (F.size(parts) >= 3))
    return found.withColumns({"project_id": parts[0], "session_id": parts[1], "is_main": stem == parts[1], "file_key": F.col("key")}).drop("key")


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, error = [], []
        for key, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            try:
                raw = lzma.decompress(content) if key.endswith(".xz") else content
                text.append(raw.decode("utf-8", "replace"))
                error.append(None)
            except (lzma.LZMAError, EOFError) as e:
                text.append(None)
                error.append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["file_key", "text", "error"])


def texts(files: DataFrame, key: str = "file_key") -> DataFrame:
    """(file_key, text, error): contents as text; a damaged object has an error and no text, the others are unaffected."""
    return files.select(F.col(key), "content").mapInArrow(_inflate, "file_key string, text string, error string")


def lines(text: DataFrame) -> DataFrame:
    """(file_key, line_num, value) of the lines that aren't blank; blank lines count for the numbers, which begin at 1."""
    split = F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "value")
    return text.where("text is not null").select("file_key", split).where(F.trim("value") != "").select("file_key", (F.col("pos") + 1).alias("line_num"), "value")


def read_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, damaged objects) of transcripts."""
    found = texts(files)
    return lines(found), found.where("error is not null").select("file_key", "error")


def one_object(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The object with a key, its plain form before its compressed one, inflated, with its media type; no row if there is
    neither. Nothing else is listed."""
    found = [k for k in (key, f"{key}.xz") if exists(spark, inside(root, k))][:1]
    files = objects(spark, root, found) if found else objects(spark, root).limit(0)
    return texts(files.withColumn("file_key", F.col("key"))).withColumn("media_type", media_type(F.col("file_key")))


def media_type(key: Column) -> Column:
    name = F.regexp_replace(key, r"\.xz$", "")
    return F.when(name.endswith(".jsonl"), "application/x-ndjson").when(name.endswith(".json"), "application/json").otherwise("text/plain; charset=utf-8")


def made_up(spark: SparkSession, sessions: int, turns: int, seed: int = 1) -> DataFrame:
    """(file_key, line_num, value) of made-up transcripts: a prompt and a reply for each turn, for trials at any size."""
    base = spark.range(sessions).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("t"))
    name = F.format_string("sess-%06d", "s")
    at = lambda shift: F.date_format(F.timestamp_seconds(1_767_225_600 + F.col("s") * 3600 + F.col("t") * 60 + shift), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pick = lambda n, salt: F.pmod(F.xxhash64("s", "t", F.lit(seed), F.lit(salt)), F.lit(n))
    user = F.to_json(F.struct(F.lit("user").alias("type"), at(0).alias("timestamp"), F.concat(name, F.lit("-u"), F.col("t")).alias("uuid"), F.struct(F.lit("user").alias("role"), F.concat(F.lit("prompt "), F.col("t")).alias("content")).alias("message")))
    usage = F.struct((pick(500, 1) + 10).alias("input_tokens"), (pick(900, 2) + 5).alias("output_tokens"), pick(2000, 3).alias("cache_creation_input_tokens"), pick(9000, 4).alias("cache_read_input_tokens"))
    model = F.element_at(F.array(F.lit("claude-opus-4-7"), F.lit("claude-sonnet-4-5"), F.lit("claude-haiku-4-5")), (pick(3, 5) + 1).cast("int"))
    reply = F.to_json(F.struct(F.lit("assistant").alias("type"), at(5).alias("timestamp"), F.concat(name, F.lit("-a"), F.col("t")).alias("uuid"), F.concat(F.lit("req-"), F.col("s"), F.lit("-"), F.col("t")).alias("requestId"), F.struct(F.lit("assistant").alias("role"), model.alias("model"), F.lit("done").alias("content"), usage.alias("usage")).alias("message")))
    key = F.concat(F.lit("proj"), F.col("s") % 7, F.lit("/"), name, F.lit("/"), name, F.lit(".jsonl"))
    both = F.explode(F.array(F.struct((F.col("t") * 2 + 1).alias("line_num"), user.alias("value")), F.struct((F.col("t") * 2 + 2).alias("line_num"), reply.alias("value")))).alias("x")
    return base.select(key.alias("file_key"), both).select("file_key", F.col("x.line_num").cast("int").alias("line_num"), "x.value")
