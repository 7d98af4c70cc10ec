"""Frames of a timeline report and of a session reader, from requests."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import text, time
from quillmeter.operators import buckets, scans, series
from quillmeter.operators.dedup import distinct_requests
from quillmeter.plans.panels import Tables, hit_rate

TOKENS = {"input": "fresh_tokens", "output": "output_tokens", "cache_create": "cache_creation_tokens", "cache_read": "cache_read_tokens"}
ALPHA, SLICE_ALPHA = 0.15, 0.3


def requests(t: Tables, start: datetime | None = None, end: datetime | None = None, project: str | None = None) -> DataFrame:
    """Dated requests in a range, each id once, with short model names."""
    rows = t.records.join(t.files.select("file_key", "project_id", "session_id"), "file_key").where("ts is not null")
    rows = rows.where(F.col("project_id") == project) if project else rows
    rows = rows.where(F.col("ts") >= F.lit(start)) if start else rows
    rows = rows.where(F.col("ts") <= F.lit(end)) if end else rows
    return distinct_requests(rows).select("ts", "file_key", "line_num", "project_id", "session_id", text.short_model(F.col("model")).alias("model"), *(F.col(c).alias(k) for k, c in TOKENS.items()), "cost_usd")


def bars(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Tokens, calls and cost in bars from the range's start, with their running sums."""
    width = time.bar_width(end - start)
    out = buckets.bins(rows, "ts", start, end, width, {**{k: F.col(k) for k in TOKENS}, "cost": F.col("cost_usd")})
    return series.so_far(out, [], ["bin"], [*TOKENS, "cost"])  # a few hundred bars


def cost_and_calls(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))


def burn_rates(rows: DataFrame, least: int = 3, alpha: float = ALPHA) -> DataFrame:
    """Sessions by pauses of over half an hour, with tokens for an hour, the most used model, and each rate smoothed.

    least: events that a session must have; 1 keeps all.
    """
    numbered = series.with_session(rows, [], "ts", ["file_key", "line_num"])
    models = numbered.groupBy("session_no", "model").agg(F.count("*").alias("n")).groupBy("session_no").agg(F.max_by("model", F.struct("n", "model")).alias("primary_model"))
    found = numbered.groupBy("session_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"), *(F.sum(k).alias(k) for k in TOKENS), F.sum("cost_usd").alias("cost")).where(F.col("events") >= least)
    out = series.hourly_rates(found, [*TOKENS, "cost"]).join(models, "session_no")
    out = series.emas(out, [], ["start", "session_no"], {f"{k}_ema": f"{k}_per_h" for k in TOKENS}, alpha)  # sessions, not requests
    return out.withColumn("cost_per_100h", F.col("cost_per_h") * 100)


def shifts(rates: DataFrame, column: str = "output_ema") -> DataFrame:
    """Where a smoothed rate doubled or halved against the ten sessions before; one of each day."""
    one = rates.select(F.lit(0).alias("one"), "start", "session_no", column)
    return series.shift_clusters(series.shifts(one, ["one"], "start", ["session_no"], column), ["one"], "start", ["session_no"]).drop("one")


def slices(rows: DataFrame, minutes: int = 30, alpha: float = SLICE_ALPHA) -> DataFrame:
    """Rates within sessions, in slices from their start, smoothed over time."""
    out = series.session_slices(rows, [], "ts", list(TOKENS), slice_s=60 * minutes)
    return series.ema(out, [], ["mid", "session_no", "slice"], "output_per_h", alpha, "output_ema")


def boundaries(rows: DataFrame, middle: bool = False, gap_s: int = 18000) -> DataFrame:
    """Where pauses of five hours lie."""
    return series.gap_boundaries(rows, [], "ts", gap_s, middle)


def limit_hits(t: Tables, start: datetime, end: datetime, apart_s: float = 60) -> DataFrame:
    """Limit hits in a range that lie more than a minute after the last one that was kept."""
    hits = t.files.select(F.explode("rate_limit_hits").alias("h")).select(F.lit(0).alias("one"), time.instant(F.col("h.ts")).alias("ts"), F.col("h.content").alias("content"))
    return scans.kept_apart(hits.where(F.col("ts").between(F.lit(start), F.lit(end))), ["one"], "ts", ["content"], apart_s).drop("one")


def short_cache_share(hourly: DataFrame) -> DataFrame:
    """One row: of buckets with cache writes, the median and 95th percentile (as members) of the share kept 5 minutes."""
    by = hourly.groupBy("bucket").agg(F.sum("cache_5m_tokens").alias("a"), F.sum("cache_1h_tokens").alias("b")).where("a + b > 0")
    return series.nearest_rank(by.select(F.lit(0).alias("one"), (100 * F.col("a") / (F.col("a") + F.col("b"))).alias("share")), ["one"], "share", (0.5, 0.95)).drop("one")


def turn_growth(traces: DataFrame) -> DataFrame:
    """Context by turn over all files: n, median, quartiles and 90th percentile, as members."""
    turns = traces.select("file_key", F.explode("ctx_turns").alias("t")).select("file_key", "t.idx", F.col("t.input").alias("input"))
    return series.nearest_rank(turns, ["idx"], "input", (0.25, 0.5, 0.75, 0.9))


def error_trend(calls: DataFrame, top: int = 5, alpha: float = ALPHA) -> DataFrame:
    """Smoothed error rates of all tools, the most used ones and the others, from bucketed (n_total, n_error)."""
    rates = series.error_rates(calls, "bucket", "tool", "n_total", "n_error", top)
    return series.ema(rates, ["series"], ["bucket"], "rate", alpha, "rate_ema")


def session_stats(shown: DataFrame, recs: DataFrame) -> DataFrame:
    """By file: first and last time, rows by kind, calls by tool, tokens, cost and hit rate."""
    kinds = shown.groupBy("file_key", "kind").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    kinds = kinds.groupBy("file_key").agg(F.min("first").alias("first_ts"), F.max("last").alias("last_ts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    tools = shown.where(F.col("kind").isin("tool_use", "server_tool_use", "agent_spawn")).groupBy("file_key", F.col("text").alias("tool")).agg(F.count("*").alias("n"))
    tools = tools.groupBy("file_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    sums = recs.groupBy("file_key").agg(*(F.sum(c).alias(c) for c in TOKENS.values()), F.sum("cost_usd").alias("cost_usd"))
    return kinds.join(tools, "file_key", "left").join(sums, "file_key", "left").withColumn("hit_rate", hit_rate())


def calls_with_results(shown_lines: DataFrame) -> DataFrame:
    """(file_key, id, call_line, result_line) of each tool call, without a line if it has no result; from events."""
    block = lambda path: F.expr(f"try_variant_get(b, '{path}', 'string')")
    blocks = shown_lines.select("file_key", "line_num", F.explode("blocks").alias("b"))
    calls = blocks.where(block("$.type").isin("tool_use", "server_tool_use")).select("file_key", block("$.id").alias("id"), F.col("line_num").alias("call_line"))
    results = blocks.where(block("$.type") == "tool_result").groupBy("file_key", block("$.tool_use_id").alias("id")).agg(F.max("line_num").alias("result_line"))
    return calls.join(results, ["file_key", "id"], "left")


def smoothed_alpha(df: DataFrame, by: list[str]) -> DataFrame:
    """df with the smoothing its series are drawn with."""
    return df.withColumn("alpha", series.display_alpha(F.count("*").over(Window.partitionBy(*by))))


def default_range(now: datetime) -> tuple[datetime, datetime]:
    return now - timedelta(hours=24), now
