"""The result frames of a dashboard, from stored tables.

Tables is what a deployment keeps: files, records (with is_canonical), tool_uses and the three rollups. View is what a
reader asks for. Buckets of an hour or more are answered from rollups, narrower ones from the requests themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import pricing, time
from quillmeter.operators import buckets, rollups
from quillmeter.operators.rollups import TOKENS, named_model

ZONE = "Europe/Prague"
NO_MODEL = ("unknown", "<synthetic>")
TOP, SESSIONS, PROJECTS = 10, 500, 10


@dataclass(frozen=True)
class Tables:
    files: DataFrame
    records: DataFrame
    tool_uses: DataFrame
    usage: DataFrame
    tools: DataFrame
    latency: DataFrame

    @classmethod
    def build(cls, files: DataFrame, records: DataFrame, tool_uses: DataFrame) -> Tables:
        return cls(files, records, tool_uses, rollups.usage(records, files), rollups.tools(tool_uses, records, files), rollups.latency(records, files))


@dataclass(frozen=True)
class View:
    """since: the range's beginning; width: of buckets in seconds; model is a LIKE fragment."""

    since: datetime
    width: int
    project: str | None = None
    model: str | None = None

    @classmethod
    def of(cls, span: str, now: datetime, project: str | None = None, model: str | None = None) -> View:
        delta: timedelta = time.span_of(span, now)
        return cls(now - delta, time.adaptive_width(delta), project, model)

    @property
    def rolled(self) -> bool:
        return self.width >= 3600

    def scoped(self, df: DataFrame, ts: str | None = None, model: bool = True) -> DataFrame:
        if ts:
            df = df.where(F.col(ts) >= F.lit(time.truncated_since(self.since, self.width) if ts == "hour" else self.since))
        if self.project:
            df = df.where(F.col("project_id") == self.project)
        if model and self.model:
            df = df.where(F.col("model").like(f"%{self.model}%"))
        return df


def _requests(t: Tables, v: View) -> DataFrame:
    """Canonical requests in range, with their file."""
    rows = t.records.where("is_canonical").join(t.files.select("file_key", "project_id", "session_id", "is_main"), "file_key")
    return v.scoped(rows, "ts")


def usage_source(t: Tables, v: View) -> DataFrame:
    """Rolled-up hours, or requests in the rollup's columns."""
    if v.rolled:
        return v.scoped(t.usage, "hour")
    return _requests(t, v).select("session_id", "project_id", F.col("ts").alias("hour"), named_model().alias("model"), "is_main", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), F.lit(1).cast("long").alias("requests"), *TOKENS, "cost_usd")


def churn_source(t: Tables, v: View) -> DataFrame:
    """(hour, lines_added, lines_deleted) of calls that changed lines."""
    if v.rolled:
        rows = v.scoped(t.tools, "hour")
    else:
        rows = t.tool_uses.join(t.files.select("file_key", "project_id"), "file_key")
        rows = rollups.with_model(rows, t.records) if v.model else rows
        rows = v.scoped(rows, "ts").withColumn("hour", F.col("ts"))
    return rows.where("lines_added > 0 or lines_deleted > 0").select("hour", "lines_added", "lines_deleted")


def hourly(t: Tables, v: View, every_hour: bool = False) -> DataFrame:
    """Tokens, cost and requests by bucket and model. session_count and churn stand on a bucket's first model only;
    sessions counts the bucket's different sessions of all models. every_hour keeps buckets with churn but no usage."""
    src = usage_source(t, v)
    at = time.bucket_center(F.col("hour"), v.width)
    rows = src.groupBy(at.alias("bucket"), "model").agg(
        F.sum("fresh_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_creation_tokens").alias("cache_creation_tokens"), F.sum("eph5_tokens").alias("cache_5m_tokens"),
        F.sum("eph1h_tokens").alias("cache_1h_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"), F.sum("cost_usd").alias("cost"), F.sum("requests").alias("requests"), F.count_distinct("session_id").alias("session_count"))
    per_bucket = src.groupBy(at.alias("bucket")).agg(F.count_distinct("session_id").alias("sessions"))
    churn = churn_source(t, v).groupBy(at.alias("bucket")).agg(F.sum("lines_added").alias("lines_added"), F.sum("lines_deleted").alias("lines_deleted"))
    out = rows.join(per_bucket, "bucket").join(churn, "bucket", "full" if every_hour else "left").fillna(0, ["lines_added", "lines_deleted", "session_count", "sessions"])
    return buckets.first_row_only(out, "bucket", ["model"], ["session_count", "lines_added", "lines_deleted"])


def cost_by_model(t: Tables, v: View) -> DataFrame:
    return usage_source(t, v).groupBy(F.col("model").alias("label")).agg(F.sum("cost_usd").alias("cost")).where("cost > 0")


def cost_by_project(t: Tables, v: View, n: int = PROJECTS) -> DataFrame:
    """The dearest projects, and the rest as one."""
    cost = usage_source(t, v).groupBy("project_id").agg(F.sum("cost_usd").alias("cost")).where("cost > 0")
    return folded(cost, "project_id", "cost", n)


def folded(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(label, value): the n largest rows, and the sum of the others under Other (m projects)."""
    top = df.orderBy(F.desc(value), key).limit(n)
    rest = df.join(F.broadcast(top.select(key)), key, "left_anti").agg(F.concat(F.lit("Other ("), F.count("*"), F.lit(" projects)")).alias("label"), F.sum(value).alias(value))  # n rows
    return top.select(F.col(key).alias("label"), value).union(rest.where(F.col(value).isNotNull()))


def response_sizes(t: Tables, v: View) -> DataFrame:
    rows = _requests(t, v).where("text_chars > 0").withColumn("model", named_model())
    return buckets.percentiles(rows, "ts", v.width, ["model"], "text_chars", (0.5, 0.9))


def sessions(t: Tables, v: View, n: int | None = SESSIONS) -> DataFrame:
    """The dearest sessions, with their most used real model, all real models, and the context they ended with."""
    sums = {"requests": "requests", "input_tokens": "fresh_tokens", "output_tokens": "output_tokens", "cache_create_tokens": "cache_creation_tokens", "cache_read_tokens": "cache_read_tokens", "cost_usd": "cost_usd"}
    by_model = usage_source(t, v).groupBy("session_id", "model").agg(*(F.sum(c).alias(k) for k, c in sums.items()), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    real = ~F.col("model").isin(*NO_MODEL)
    rank = F.struct(real, "requests", F.col("model"))
    found = by_model.groupBy("session_id").agg(
        F.min("first_ts").alias("start"), F.max("last_ts").alias("end"), *(F.sum(k).alias(k) for k in sums), F.max_by("model", rank).alias("model"), F.array_sort(F.collect_set(F.when(real, F.col("model")))).alias("models_used"))
    found = found if n is None else found.orderBy(F.desc_nulls_last("cost_usd"), "session_id").limit(n)
    last = t.files.where(F.col("is_main") & (F.size("ctx_turns") > 0)).select("session_id", F.element_at("ctx_turns", -1)["input"].alias("ctx_at_end"))
    return found.join(last.groupBy("session_id").agg(F.max("ctx_at_end").alias("ctx_at_end")), "session_id", "left")


def _scoped_files(t: Tables, v: View) -> DataFrame:
    files = t.files.where(F.col("last_modified") >= F.lit(v.since))
    return files.where(F.col("project_id") == v.project) if v.project else files


def ctx_traces(t: Tables, v: View) -> DataFrame:
    """Context turns of each file, with its most frequent model; real models are preferred."""
    scope = _scoped_files(t, v).where(F.size("ctx_turns") > 0)
    models = t.records.join(scope.select("file_key"), "file_key", "left_semi").groupBy("file_key").agg(
        F.expr("coalesce(mode() within group (order by case when model not in ('', '<synthetic>') then model end), mode() within group (order by nullif(model, '')))").alias("model"))
    return scope.join(models, "file_key", "left").select("file_key", "session_id", "is_main", F.coalesce("model", F.lit("")).alias("model"), "ctx_turns")


def rate_limit_hits(t: Tables, v: View) -> DataFrame:
    """Hits in range by their own time; malformed times are left out."""
    rows = _scoped_files(t, v).where(F.size("rate_limit_hits") > 0).select("session_id", F.explode("rate_limit_hits").alias("h"))
    return rows.select("session_id", time.instant(F.col("h.ts")).alias("ts"), F.col("h.content").alias("content")).where(F.col("ts") >= F.lit(v.since))


def counters(t: Tables, v: View) -> DataFrame:
    """One row: sessions, files by kind, prompts and turns."""
    used = t.records.select("file_key").distinct().withColumn("used", F.lit(True))
    main = t.files.where("is_main").select("session_id").distinct().withColumn("has_main", F.lit(True))
    files = _scoped_files(t, v).join(used, "file_key", "left").join(main, "session_id", "left").fillna(False, ["used", "has_main"])
    alone = F.when(~F.col("has_main") & F.col("used"), F.col("session_id"))
    counts = files.agg(
        F.count_if(F.col("is_main") & F.col("used")).alias("main_w_usage"), F.count_if(F.col("is_main") & ~F.col("used")).alias("main_empty"), F.count_if(~F.col("is_main")).alias("subagent_files"),
        F.count_distinct(alone).alias("subagent_only_sessions"), F.coalesce(F.sum("prompt_count"), F.lit(0)).alias("total_prompts"), F.coalesce(F.sum("turn_count"), F.lit(0)).alias("total_turns"))
    return usage_source(t, v).agg(F.count_distinct("session_id").alias("total_sessions")).crossJoin(counts)  # one row each


def cache_per_model(t: Tables, v: View, dated=pricing.DATED) -> DataFrame:
    """By model: tokens, cost by part, hit rate in percent, and whether its price is a guess. Sums are priced by rate
    epoch and rounded once, so that parts add up to the total."""
    at = pricing.rate_epoch(F.col("ts"), dated)
    rows = _requests(t, v).groupBy("model", at.alias("epoch")).agg(F.min("ts").alias("ts"), F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in TOKENS))
    rows = rows.withColumn("rate", pricing.resolve(F.col("model"), F.col("ts"), dated=dated))
    parts = pricing.part_costs(F.col("rate.rates"), *(F.col(c) for c in ("fresh_tokens", "cache_creation_tokens", "eph5_tokens", "eph1h_tokens", "cache_read_tokens", "output_tokens")))
    rows = rows.withColumns({f"{k}_cost": c for k, c in parts.items()}).withColumn("estimated", F.col("rate.estimated"))
    sums = [*TOKENS, "requests", *(f"{k}_cost" for k in parts)]
    out = rows.groupBy("model").agg(*(F.sum(c).alias(c) for c in sums), F.bool_or("estimated").alias("estimated"))
    return out.withColumns({"cost": sum(F.col(f"{k}_cost") for k in parts), "hit_rate": hit_rate()})


def hit_rate():
    seen = F.col("fresh_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return F.when(seen > 0, 100.0 * F.col("cache_read_tokens") / seen).otherwise(0.0)


def cache_total(per_model: DataFrame) -> DataFrame:
    """One row for all models."""
    return per_model.agg(*(F.sum(c).alias(c) for c in (*TOKENS, "requests", "cost")), F.bool_or("estimated").alias("estimated")).withColumn("hit_rate", hit_rate())


def top_requests(t: Tables, v: View, by: str, n: int = TOP) -> DataFrame:
    """The requests with most of a kind of tokens, output ones even if none."""
    rows = _requests(t, v)
    rows = rows if by == "output_tokens" else rows.where(F.col(by) > 0)
    return rows.orderBy(F.desc(by), "file_key", "line_num").limit(n).select("file_key", "line_num", "session_id", "project_id", "model", "ts", *TOKENS, "cost_usd")


def tool_usage(t: Tables, v: View) -> DataFrame:
    if v.rolled:
        rows, n = v.scoped(t.tools, "hour").withColumn("ts", F.col("hour")), F.sum("n_total")
    else:
        rows, n = t.tool_uses.join(t.files.select("file_key", "project_id"), "file_key"), F.count("*")
        rows = v.scoped(rollups.with_model(rows, t.records) if v.model else rows, "ts")
    return rows.groupBy(time.bucket_center(F.col("ts"), v.width).alias("bucket"), F.col("tool_name").alias("tool")).agg(n.alias("n"))


def tool_error_rate(t: Tables, v: View) -> DataFrame:
    """Calls with a result and a request, and failed ones, by bucket, model and tool."""
    if v.rolled:
        rows = v.scoped(t.tools.where("model <> ''"), "hour").select("hour", "model", "tool_name", "n_rated", "n_error")
    else:
        calls = rollups.with_model(t.tool_uses.where("is_error is not null"), t.records).where("model is not null").join(t.files.select("file_key", "project_id"), "file_key")
        rows = v.scoped(calls, "ts").select(F.col("ts").alias("hour"), "model", "tool_name", F.lit(1).alias("n_rated"), F.col("is_error").cast("int").alias("n_error"))
    out = rows.groupBy(time.bucket_center(F.col("hour"), v.width).alias("bucket"), "model", F.col("tool_name").alias("tool")).agg(F.sum("n_rated").alias("n_total"), F.sum("n_error").alias("n_error"))
    return out.where("n_total > 0")


def activity_heatmap(t: Tables, v: View, zone: str = ZONE) -> DataFrame:
    rows = v.scoped(t.usage, "hour") if v.rolled else usage_source(t, v)
    return buckets.heatmap(rows, "hour", zone, {"requests": F.col("requests"), "output_tokens": F.col("output_tokens"), "cost": F.col("cost_usd")}).drop("n")


def reply_latency(t: Tables, v: View) -> DataFrame:
    """Percentile bands with their outliers, from the rollup where it keeps the width."""
    if v.width in rollups.LATENCY_WIDTHS:
        rows = t.latency.where((F.col("bucket_s") == v.width) & (F.col("project_id") == (v.project or "")) & (F.col("bucket") >= time.bucket_center(F.lit(v.since), v.width)))
    else:
        rows = rollups.latency(t.records.where(F.col("ts") >= F.lit(v.since)), t.files, (v.width,)).where(F.col("project_id") == (v.project or ""))
    rows = rows.where(F.col("model").like(f"%{v.model}%")) if v.model else rows
    return rows.select("bucket", "model", "n", "p10", "p50", "p90", "outliers")


def latency_outliers(bands: DataFrame) -> DataFrame:
    return bands.select("model", F.explode("outliers").alias("o")).select("model", "o.ts", "o.latency_s", "o.file_key", "o.line_num", "o.kind")


def models(t: Tables) -> DataFrame:
    """Models by number of requests; undated and repeated requests count."""
    return t.records.where("model <> '' and model <> '<synthetic>'").groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model")


def projects(t: Tables, v: View) -> DataFrame:
    """Projects with their sessions and what they cost in range, if they ever cost anything; dearest first."""
    counts = t.files.groupBy("project_id").agg(F.count_distinct("session_id").alias("session_count"))
    ever = t.usage.groupBy("project_id").agg(F.sum("cost_usd").alias("ever")).where("ever <> 0")
    now = v.scoped(t.usage, "hour").groupBy("project_id").agg(F.sum("cost_usd").alias("cost"))
    out = counts.join(ever, "project_id").join(now, "project_id", "left").select("project_id", F.col("project_id").alias("display_name"), "session_count", F.coalesce("cost", F.lit(0)).alias("total_cost"))
    return out.orderBy(F.desc("total_cost"), "project_id")


def context_growth(t: Tables, v: View) -> DataFrame:
    """Two rows, for turn counts and final inputs of main files: n, mean, p50, p90, p99, max."""
    files = _scoped_files(t, v).where(F.col("is_main") & (F.size("ctx_turns") > 0))
    rows = files.select(F.explode(F.array(F.struct(F.lit("turns").alias("what"), F.size("ctx_turns").cast("double").alias("x")), F.struct(F.lit("final").alias("what"), F.element_at("ctx_turns", -1)["input"].cast("double").alias("x")))).alias("e")).select("e.*")
    points = [F.percentile("x", F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.9, 0.99)]
    return rows.groupBy("what").agg(F.count("*").alias("n"), F.avg("x").cast("long").alias("mean"), *points, F.max("x").alias("max"))


def session_context(t: Tables, session_id: str) -> DataFrame:
    rows = t.files.where(F.col("is_main") & (F.col("session_id") == session_id))
    return rows.select("session_id", F.col("ctx_turns").alias("turns"), F.size("ctx_turns").alias("total"), F.try_element_at("ctx_turns", F.lit(-1))["input"].alias("final"))


def session_list(t: Tables, project: str | None = None, limit: int = 50, cursor: tuple[datetime, str] | None = None, sort: str | None = None) -> DataFrame:
    """Sessions, latest beginning first, or by falling values of another column; pages are told apart by (beginning,
    session), so that ties lose nothing."""
    rows = t.records.where("is_canonical").join(t.files.select("file_key", "project_id", "session_id"), "file_key")
    rows = rows.where(F.col("project_id") == project) if project else rows
    tokens = ("fresh_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
    by_model = rows.groupBy("session_id", "project_id", "model").agg(F.count("*").alias("n"), F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at"), *(F.sum(c).alias(c) for c in tokens), F.sum("cost_usd").alias("cost_usd"))
    out = by_model.groupBy("session_id", "project_id").agg(
        F.min("first_event_at").alias("first_event_at"), F.max("last_event_at").alias("last_event_at"), *(F.sum(c).alias(c) for c in (*tokens, "cost_usd")), F.sum("n").alias("requests"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("models"))
    out = out.withColumn("duration_s", F.unix_seconds("last_event_at") - F.unix_seconds("first_event_at"))
    at = F.coalesce("first_event_at", F.lit(time.EPOCH))
    if cursor:
        out = out.where((at < F.lit(cursor[0])) | (at == F.lit(cursor[0])) & (F.col("session_id") > cursor[1]))
    return out.orderBy(F.desc_nulls_last(sort) if sort else at.desc(), "session_id").limit(limit + 1)


def session_detail(t: Tables, session_id: str) -> DataFrame:
    """A session's main file, repeats included: sums, models, most used model, trace, tokens put out for a second."""
    rows = t.files.where(F.col("is_main") & (F.col("session_id") == session_id)).select("file_key", "session_id", "project_id", "ctx_turns").join(t.records, "file_key", "left")
    tokens = ("fresh_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "cost_usd")
    by_model = rows.groupBy("session_id", "project_id", "ctx_turns", "model").agg(F.count("line_num").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), *(F.sum(c).alias(c) for c in tokens))
    out = by_model.groupBy("session_id", "project_id", "ctx_turns").agg(
        F.min("first").alias("first_event_at"), F.max("last").alias("last_event_at"), *(F.sum(c).alias(c) for c in tokens), F.max_by("model", F.struct("n", "model")).alias("model"),
        F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct("model", "n")))).alias("models"))
    length = F.unix_seconds("last_event_at") - F.unix_seconds("first_event_at")
    return out.withColumns({"duration_s": length, "tps": F.when(length > 0, F.col("output_tokens") / length)})


def token_breakdown(t: Tables, v: View) -> DataFrame:
    """(category, tokens, cost, share) of the range; cost with full model names."""
    rows = cache_per_model(t, v)
    cells = [("input", "fresh_tokens", "fresh_cost"), ("output", "output_tokens", "output_cost"), ("cache_5m", None, "create_5m_cost"), ("cache_1h", "eph1h_tokens", "create_1h_cost"), ("cache_read", "cache_read_tokens", "read_cost")]
    short = F.col("cache_creation_tokens") - F.col("eph1h_tokens")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("category"), (F.col(c) if c else short).alias("tokens"), F.col(d).alias("cost")) for k, c, d in cells))).alias("e")
    out = rows.select(each).groupBy("e.category").agg(F.sum("e.tokens").alias("tokens"), F.sum("e.cost").alias("cost"))
    return out.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # five rows
