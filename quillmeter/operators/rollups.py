"""Pre-aggregated tables that panels read instead of requests: usage, tool calls, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.functions.time import bucket_center
from quillmeter.operators import quantiles, scans
from quillmeter.operators.buckets import outlier_ends, outliers

TOKENS = ("fresh_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "eph5_tokens", "eph1h_tokens")
#: Bucket widths for which latencies are kept; percentiles of a wider bucket don't follow from those of narrower ones.
LATENCY_WIDTHS = (3600, 21600, 43200, 86400)
_FILE = ("file_key", "project_id", "session_id", "is_main")
USAGE_KEYS = ("session_id", "project_id", "hour", "model", "is_main")
TOOL_KEYS, TOOL_COUNTS = ("hour", "project_id", "model", "tool_name"), ("n_total", "n_rated", "n_error", "lines_added", "lines_deleted")
LATENCY_KEYS = ("bucket_s", "bucket", "project_id", "model")


def named_model(model: str = "model"):
    return F.coalesce(F.nullif(F.col(model), F.lit("")), F.lit("unknown"))


def usage_rows(records: DataFrame, files: DataFrame) -> DataFrame:
    """Canonical dated requests with the keys of their usage group."""
    rows = records.where("is_canonical and ts is not null").join(files.select(*_FILE), "file_key")
    return rows.select("session_id", "project_id", F.date_trunc("hour", "ts").alias("hour"), named_model().alias("model"), "is_main", "ts", *TOKENS, "cost_usd")


def usage(records: DataFrame, files: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """By session, hour, model and kind of file, of canonical dated requests; only the groups of a frame of keys, if given."""
    rows = usage_rows(records, files)
    rows = rows if only is None else rows.join(only, list(USAGE_KEYS), "left_semi")
    return rows.groupBy(*USAGE_KEYS).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in (*TOKENS, "cost_usd")))


def with_model(tool_uses: DataFrame, records: DataFrame, by_request: bool = True) -> DataFrame:
    """Tool calls with the model of their request, null without one.

    Requests are found by their id; with by_request=False by the line alone, which misses the calls on a request's later
    lines, as stored rollups of old did.
    """
    if not by_request:
        return tool_uses.join(records.select("file_key", "line_num", "model"), ["file_key", "line_num"], "left")
    known = records.select("file_key", F.when(F.col("request_id") == "", F.concat(F.lit("#"), F.col("line_num"))).otherwise(F.concat(F.lit("="), F.col("request_id"))).alias("_r"), "model")
    calls = tool_uses.withColumn("_r", F.when(F.col("request_id") == "", F.concat(F.lit("#"), F.col("line_num"))).otherwise(F.concat(F.lit("="), F.col("request_id"))))
    return calls.join(known, ["file_key", "_r"], "left").drop("_r")


def tools(tool_uses: DataFrame, records: DataFrame, files: DataFrame, by_request: bool = True) -> DataFrame:
    """By hour, project, model ('' without a request) and tool; n_rated counts calls with a result and a request."""
    rows = with_model(tool_uses.where("ts is not null"), records, by_request).join(files.select("file_key", "project_id"), "file_key")
    rated = F.col("is_error").isNotNull() & F.col("model").isNotNull()
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour"), "project_id", F.coalesce("model", F.lit("")).alias("model"), "tool_name").agg(
        F.count("*").alias("n_total"), F.count_if(rated).alias("n_rated"), F.count_if(rated & F.col("is_error")).alias("n_error"), F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted"))


def latency_rows(records: DataFrame, files: DataFrame, widths=LATENCY_WIDTHS) -> DataFrame:
    """A row for each reply, width, and its project and all projects, with the keys of their group."""
    rows = records.where("reply_latency_s is not null and ts is not null").join(files.select("file_key", "project_id"), "file_key")
    rows = rows.select("project_id", named_model().alias("model"), "ts", "file_key", "line_num", F.col("reply_latency_s").cast("double").alias("latency_s"))
    wide = rows.select("*", F.explode(F.array(*(F.struct(F.lit(w).alias("bucket_s"), bucket_center(F.col("ts"), w).alias("bucket")) for w in widths))).alias("b")).select("*", "b.*").drop("b")
    return wide.withColumn("project_id", F.explode(F.array("project_id", F.lit(""))))


def latency(records: DataFrame, files: DataFrame, widths=LATENCY_WIDTHS, only: DataFrame | None = None) -> DataFrame:
    """(bucket_s, bucket, project_id, model, n, p10, p50, p90, outliers), for each project and, under '', for all; only the
    groups of a frame of keys, if given.

    Outliers are the slowest and fastest hundredth of a group of at least a hundred, as an array, slowest first.
    """
    keys = list(LATENCY_KEYS)
    wide = latency_rows(records, files, widths)
    wide = wide if only is None else wide.join(only, keys, "left_semi")
    points = {f"p{round(100 * p)}": p for p in (0.1, 0.5, 0.9)}
    ends = quantiles.interpolated(wide, keys, "latency_s", points | outlier_ends())
    bands, far = ends.select(*keys, "n", *points), outliers(wide, keys, "latency_s", ["file_key", "line_num"], ends=ends)
    item = F.struct((-F.col("latency_s")).alias("_o"), "ts", "latency_s", "file_key", "line_num", "kind")
    lists = far.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[c].alias(c) for c in ("ts", "latency_s", "file_key", "line_num", "kind")))).alias("outliers"))
    empty = F.array().cast(lists.schema["outliers"].dataType)
    return bands.join(lists, keys, "left").withColumn("outliers", F.coalesce("outliers", empty))


def session_numbers(usage_rollup: DataFrame) -> DataFrame:
    """(session_id, number): dense numbers of the sessions of a usage rollup, for their bitmaps."""
    return scans.numbered(usage_rollup.select("session_id").distinct(), ["session_id"])


def session_bitmaps(usage_rollup: DataFrame, numbers: DataFrame) -> DataFrame:
    """(hour, project_id, model, part, sessions): which sessions have requests in a group, as bitmaps of 32,768 numbers each.

    Distinct counts can't be added up, bitmaps can be merged: those of any hours, projects and models give the exact count
    by sessions_in, without the session ids.
    """
    rows = usage_rollup.select("hour", "project_id", "model", "session_id").join(numbers, "session_id")
    return rows.groupBy("hour", "project_id", "model", F.bitmap_bucket_number("number").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("sessions"))


def sessions_in(bitmaps: DataFrame, by: list) -> DataFrame:
    """(by, session_count): exact numbers of different sessions, from bitmaps alone."""
    merged = bitmaps.groupBy(*by, "part").agg(F.bitmap_or_agg("sessions").alias("_all"))
    names = [c for c in merged.columns if c not in ("part", "_all")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("_all")).alias("session_count"))
