"""Stored tables made of the driver's events, and every rollup, panel and report frame on them.

A user's events are a transcript: purchases, views and errors are its requests, clicks and purchases its tool calls,
signups its context turns. Ids modulo small numbers decide on duplicates, missing times, models and results.
"""

from __future__ import annotations

from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import time
from quillmeter.operators import buckets, rollups, series, transcript
from quillmeter.operators.dedup import canonical
from quillmeter.plans import panels, timeline
from quillmeter.registry import center, query, r, sec
from quillmeter.sources import tables, versions
from quillmeter.streaming import incremental

SINCE = datetime(2024, 1, 9, 5, 30, tzinfo=UTC)
ROLLED, LIVE = panels.View(SINCE, 21600), panels.View(SINCE, 1800)
PART = panels.View(SINCE, 3600, project="p3", model="opus")
MODELS = ("claude-opus-4-7", "claude-sonnet-4-5", "claude-haiku-4-5-20251001", "<synthetic>", "")
TOOLS = ("Bash", "Edit", "Read", "Write")
WIDE = 30 * 86400


def stored(t) -> panels.Tables:
    return panels.Tables.build(*parsed(t))


def parsed(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, records, tool_uses) without rollups."""
    ev = t("events")
    i, user = F.col("event_id"), F.col("user_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    session = user % 60
    where = {"project_id": F.concat(F.lit("p"), session % 7), "session_id": F.concat(F.lit("s"), session), "is_main": user < 60}
    ev = ev.withColumns({**where, "file_key": F.concat(where["project_id"], F.lit("/"), where["session_id"], F.lit("/f"), user), "at": F.when(i % 53 != 0, F.col("ts"))})
    w = Window.partitionBy("file_key").orderBy("ts", "event_id")
    given = F.floor(F.col("value") * 100).cast("long")
    turns = ev.where("event_type = 'signup'").select("file_key", F.struct(F.row_number().over(w).alias("idx"), "ts", i.alias("line"), given.alias("input"), (i % 50).alias("output"), (given - F.lag(given, 1, 0).over(w)).alias("delta")).alias("x"))
    stamp = F.when(i % 194 == 0, "nonsense").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    hits = ev.where(i % 97 == 0).select("file_key", F.struct(i.alias("line"), stamp.alias("ts"), F.concat(F.lit("out "), i).alias("content")).alias("h"))
    files = ev.groupBy("file_key", *where).agg(F.max("ts").alias("last_modified"), F.count_if(F.col("event_type") == "click").cast("int").alias("prompt_count"))
    for name, rows in (("ctx_turns", turns), ("rate_limit_hits", hits)):
        lists = rows.groupBy("file_key").agg(F.array_sort(F.collect_list(rows.columns[1])).alias(name))
        files = files.join(lists, "file_key", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    made = i % 500
    counts = {"fresh_tokens": i % 1000, "output_tokens": F.floor(F.col("value") * 10), "cache_creation_tokens": made, "cache_read_tokens": i % 3000, "eph5_tokens": F.floor(made / 4), "eph1h_tokens": F.floor(made / 2)}
    records = ev.where("event_type in ('purchase', 'view', 'error')").select(
        "file_key", i.cast("int").alias("line_num"), F.when(i % 10 != 0, F.concat(F.lit("u"), F.floor(i / 2))).alias("uuid"), F.concat(F.lit("r"), i).alias("request_id"), F.col("at").alias("ts"), pick(MODELS).alias("model"),
        *(c.cast("long").alias(k) for k, c in counts.items()), (i % 400).alias("text_chars"), F.round(F.col("value") / 100, 6).cast("decimal(12,6)").alias("cost_usd"),
        F.when(i % 4 > 0, F.col("value") / 10).cast("decimal(10,3)").alias("reply_latency_s"), F.lit(False).alias("estimated"))
    calls = ev.where("event_type in ('click', 'purchase')").select(
        "file_key", i.cast("int").alias("line_num"), F.lit(0).alias("idx"), F.concat(F.when(F.col("event_type") == "purchase", "r").otherwise("x"), i).alias("request_id"), F.col("at").alias("ts"), pick(TOOLS).alias("tool_name"),
        F.when(i % 3 > 0, i % 2 == 0).alias("is_error"), (i % 30).alias("lines_added"), (i % 7).alias("lines_deleted"))
    return files.withColumn("turn_count", F.size("ctx_turns")), canonical(records), calls


def _case(names: tuple[str, ...]) -> str:
    return f"case event_id % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


_SINCE = "timestamp '2024-01-09 05:30:00'"
_SUMS = "sum(fresh_tokens)::bigint as fresh_tokens, sum(output_tokens)::bigint as output_tokens, sum(cache_creation_tokens)::bigint as cache_creation_tokens, sum(cache_read_tokens)::bigint as cache_read_tokens, sum(eph5_tokens)::bigint as eph5_tokens, sum(eph1h_tokens)::bigint as eph1h_tokens"
_NAMED = "coalesce(nullif(model, ''), 'unknown')"
#: The stored tables in SQL.
STORED = f"""with ev as (select *, 'p' || (user_id % 60) % 7 as project_id, 's' || user_id % 60 as session_id, user_id < 60 as is_main, 'p' || (user_id % 60) % 7 || '/s' || user_id % 60 || '/f' || user_id as file_key, case when event_id % 53 <> 0 then ts end as dated from events),
    files as (select file_key, project_id, session_id, is_main, max(ts) as last_modified, count(*) filter (where event_type = 'click') as prompt_count from ev group by 1, 2, 3, 4),
    turns as (select file_key, row_number() over w as idx, event_id as line, ts, floor(value * 100)::bigint as input, event_id % 50 as output, floor(value * 100)::bigint - coalesce(lag(floor(value * 100)::bigint) over w, 0) as delta from ev where event_type = 'signup' window w as (partition by file_key order by ts, event_id)),
    hits as (select file_key, session_id, project_id, case when event_id % 194 <> 0 then date_trunc('second', ts) end as ts, 'out ' || event_id as content from ev where event_id % 97 = 0),
    recs as (select file_key, event_id as line_num, case when event_id % 10 <> 0 then 'u' || event_id // 2 end as uuid, 'r' || event_id as request_id, dated as ts, {_case(MODELS)} as model, event_id % 1000 as fresh_tokens, floor(value * 10)::bigint as output_tokens, event_id % 500 as cache_creation_tokens, event_id % 3000 as cache_read_tokens,
      event_id % 500 // 4 as eph5_tokens, event_id % 500 // 2 as eph1h_tokens, event_id % 400 as text_chars, round(value / 100, 6)::decimal(12, 6) as cost_usd, case when event_id % 4 > 0 then (value / 10)::decimal(10, 3) end as reply_latency_s from ev where event_type in ('purchase', 'view', 'error')),
    records as (select *, uuid is null or row_number() over (partition by uuid order by file_key, line_num) = 1 as is_canonical from recs),
    tool_uses as (select file_key, event_id as line_num, case when event_type = 'purchase' then 'r' else 'x' end || event_id as request_id, dated as ts, {_case(TOOLS)} as tool_name, case when event_id % 3 > 0 then event_id % 2 = 0 end as is_error, event_id % 30 as lines_added, event_id % 7 as lines_deleted from ev where event_type in ('click', 'purchase')),
    usage as (select session_id, project_id, date_trunc('hour', ts) as hour, {_NAMED} as model, is_main, min(ts) as first_ts, max(ts) as last_ts, count(*) as requests, {_SUMS}, sum(cost_usd)::double as cost_usd from records join files using (file_key) where is_canonical and ts is not null group by 1, 2, 3, 4, 5),
    called as (select u.*, r.model from tool_uses u left join records r on r.file_key = u.file_key and r.request_id = u.request_id),
    tools as (select date_trunc('hour', ts) as hour, project_id, coalesce(model, '') as model, tool_name, count(*) as n_total, count(*) filter (where is_error is not null and model is not null) as n_rated, count(*) filter (where is_error and model is not null) as n_error, sum(lines_added)::bigint as lines_added, sum(lines_deleted)::bigint as lines_deleted
      from called join files using (file_key) where ts is not null group by 1, 2, 3, 4),
    own as (select r.*, f.project_id, f.session_id, f.is_main, f.last_modified from records r join files f using (file_key))"""


def _source(v: panels.View) -> str:
    """A view's source of usage in SQL, with its condition."""
    only = (f" and project_id = '{v.project}'" if v.project else "") + (f" and model like '%{v.model}%'" if v.model else "")
    if v.rolled:
        return f"src as (select * from usage where hour >= date_trunc('hour', {_SINCE}){only})"
    return f"""src as (select session_id, project_id, ts as hour, {_NAMED} as model, is_main, ts as first_ts, ts as last_ts, 1 as requests, fresh_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, eph5_tokens, eph1h_tokens, cost_usd::double as cost_usd
      from own where is_canonical and ts >= {_SINCE}{only})"""


_LIVE = f"live as (select * from own where is_canonical and ts >= {_SINCE})"


def each(sql, views=(("", ROLLED), ("_live", LIVE), ("_part", PART))):
    """Registers a frame once for each view; sql is a function of the view."""

    def add(f):
        for suffix, v in views:
            g = partial(f, v=v)
            g.__name__, g.__doc__ = f.__name__ + suffix, f.__doc__
            query(sql(v))(g)
        return f

    return add


# Rollups


@query(f"""{STORED} select session_id, project_id, epoch_us(hour) // 1000000 as hour, model, is_main, epoch_us(first_ts) // 1000000 as first_s, epoch_us(last_ts) // 1000000 as last_s, requests, fresh_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, eph5_tokens, eph1h_tokens, round(cost_usd, 6) as cost from usage""")
def usage_rollup(t):
    """Usage by session, hour, model and kind of file, of canonical dated requests."""
    return stored(t).usage.select("session_id", "project_id", sec("hour").alias("hour"), "model", "is_main", sec("first_ts").alias("first_s"), sec("last_ts").alias("last_s"), "requests", *rollups.TOKENS, r("cost_usd", 6).alias("cost"))


@query(f"{STORED} select epoch_us(hour) // 1000000 as hour, project_id, model, tool_name, n_total, n_rated, n_error, lines_added, lines_deleted from tools")
def tools_rollup(t):
    """Tool calls by hour, project, model and tool; calls without a result or a request aren't rated."""
    return stored(t).tools.select(sec("hour").alias("hour"), "project_id", "model", "tool_name", "n_total", "n_rated", "n_error", "lines_added", "lines_deleted")


@query(f"""{STORED} select tool_name, count(*) as n, count(r.model) as known from tool_uses u left join records r on r.file_key = u.file_key and r.line_num = u.line_num group by 1""")
def tools_by_line(t):
    """Tool calls with the model of the request on their line, as rollups of old had it."""
    s = stored(t)
    return rollups.with_model(s.tool_uses, s.records, by_request=False).groupBy("tool_name").agg(F.count("*").alias("n"), F.count("model").alias("known"))


_BANDS = ", ".join(f"round(quantile_cont(x, {q}), 4) as p{round(100 * q)}" for q in (0.1, 0.5, 0.9))
_WAITS = f"waits as (select project_id, {_NAMED} as model, ts, file_key, line_num, reply_latency_s::double as x from own where reply_latency_s is not null and ts is not null), both_ as (select * from waits union all select '', model, ts, file_key, line_num, x from waits)"


@query(f"{STORED}, {_WAITS} " + " union all ".join(f"select {w}::bigint as bucket_s, {center(w)} as bucket, project_id, model, count(*) as n, {_BANDS} from both_ group by 2, 3, 4" for w in rollups.LATENCY_WIDTHS))
def latency_rollup(t):
    """Bands of waits for each width, project and model, and over all projects."""
    return stored(t).latency.select(F.col("bucket_s").cast("long").alias("bucket_s"), sec("bucket").alias("bucket"), "project_id", "model", "n", *(r(p).alias(p) for p in ("p10", "p50", "p90")))


@query(f"""{STORED}, {_WAITS}, o as (select *, {center(WIDE)} as bucket, count(*) over w as n, row_number() over (partition by {center(WIDE)}, project_id, model order by x desc, file_key, line_num) as hi, row_number() over (partition by {center(WIDE)}, project_id, model order by x, file_key, line_num) as lo from both_ window w as (partition by {center(WIDE)}, project_id, model))
    select bucket, project_id, model, epoch_us(ts) // 1000000 as at_s, x as latency_s, file_key, line_num, case when hi <= ceil(n * 0.01) then 'high' else 'low' end as kind from o where n >= 100 and (hi <= ceil(n * 0.01) or lo <= ceil(n * 0.01))""")
def latency_rollup_outliers(t):
    """The slowest and fastest hundredth, kept with the bands."""
    s = stored(t)
    out = rollups.latency(s.records, s.files, (WIDE,)).select(sec("bucket").alias("bucket"), "project_id", "model", F.explode("outliers").alias("o"))
    return out.select("bucket", "project_id", "model", sec("o.ts").alias("at_s"), "o.latency_s", "o.file_key", F.col("o.line_num").cast("long").alias("line_num"), "o.kind")


@query(f"""{STORED}, {_source(ROLLED)}, {_source(panels.View(SINCE.replace(minute=0), 1800)).replace("src as", "narrow as").replace("05:30", "05:00")},
    a as (select {center(21600, "hour")} as bucket, model, sum(requests)::bigint as rolled from src group by 1, 2), b as (select {center(21600, "hour")} as bucket, model, count(*) as live from narrow group by 1, 2) select bucket, model, rolled, live from a join b using (bucket, model)""")
def rollup_vs_live(t):
    """Buckets of an hour or more are the same from the rollup and from the rows."""
    s = stored(t)
    at = time.bucket_center(F.col("hour"), 21600).alias("bucket")
    rolled = panels.usage_source(s, ROLLED).groupBy(at, "model").agg(F.sum("requests").alias("rolled"))
    live = panels.usage_source(s, panels.View(SINCE.replace(minute=0), 1800)).groupBy(at, "model").agg(F.sum("requests").alias("live"))
    return rolled.join(live, ["bucket", "model"]).select(sec("bucket").alias("bucket"), "model", "rolled", "live")


# Panels


def _churn(v: panels.View) -> str:
    only = (f" and project_id = '{v.project}'" if v.project else "") + (f" and model like '%{v.model}%'" if v.model else "")
    rows = f"tools where hour >= date_trunc('hour', {_SINCE})" if v.rolled else f"(select c.*, ts as hour, project_id from called c join files using (file_key)) where hour >= {_SINCE}"
    return f"churn as (select {center(v.width, 'hour')} as bucket, sum(lines_added)::bigint as lines_added, sum(lines_deleted)::bigint as lines_deleted from {rows}{only} and (lines_added > 0 or lines_deleted > 0) group by 1)"


def _hourly(v: panels.View) -> str:
    at = center(v.width, "hour")
    return f"""{STORED}, {_source(v)}, {_churn(v)}, g as (select {at} as bucket, model, sum(requests)::bigint as requests, {_SUMS}, sum(cost_usd) as cost, count(distinct session_id) as s from src group by 1, 2), b as (select {at} as bucket, count(distinct session_id) as sessions from src group by 1),
    x as (select *, row_number() over (partition by bucket order by model) = 1 as one from g join b using (bucket) left join churn using (bucket))
    select bucket, model, fresh_tokens as input_tokens, output_tokens, cache_creation_tokens, eph5_tokens as cache_5m_tokens, eph1h_tokens as cache_1h_tokens, cache_read_tokens, round(cost, 6) as cost, requests, sessions, case when one then s else 0 end as session_count,
      case when one then coalesce(lines_added, 0) else 0 end as lines_added, case when one then coalesce(lines_deleted, 0) else 0 end as lines_deleted from x"""


@each(_hourly)
def panel_hourly(t, v):
    """Usage by bucket and model; what belongs to a bucket stands on its first row."""
    out = panels.hourly(stored(t), v)
    return out.withColumns({"bucket": sec("bucket"), "cost": r("cost", 6)}).withColumns({c: F.col(c).cast("long") for c in ("session_count", "sessions", "lines_added", "lines_deleted")})


@query(f"{STORED}, {_churn(PART)}, {_source(PART)}, g as (select {center(3600, 'hour')} as bucket, sum(requests)::bigint as requests from src group by 1) select bucket, coalesce(requests, 0) as requests, coalesce(lines_added, 0) as lines_added from g full join churn using (bucket)")
def panel_hourly_all_buckets(t):
    """Buckets with churn but no usage are kept when asked for."""
    out = panels.hourly(stored(t), PART, every_hour=True)
    return out.groupBy(sec("bucket").alias("bucket")).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.sum("lines_added").alias("lines_added"))


@each(lambda v: f"{STORED}, {_source(v)} select model as label, round(sum(cost_usd), 6) as cost from src group by 1 having sum(cost_usd) > 0")
def panel_cost_by_model(t, v):
    """Cost by model."""
    return panels.cost_by_model(stored(t), v).select("label", r("cost", 6).alias("cost"))


@each(lambda v: f"""{STORED}, {_source(v)}, g as (select project_id as k, sum(cost_usd) as v from src group by 1 having sum(cost_usd) > 0), x as (select *, row_number() over (order by round(v, 6) desc, k) as rn, count(*) over () as n from g)
    select case when rn <= 4 then k else 'Other (' || (n - 4) || ' projects)' end as label, round(sum(v), 6) as cost from x group by 1""")
def panel_cost_by_project(t, v):
    """The dearest projects and the rest."""
    return panels.cost_by_project(stored(t), v, 4).select("label", r("cost", 6).alias("cost"))


@query(f"{STORED}, {_LIVE} select {center(86400)} as bucket, {_NAMED} as model, count(*) as n, quantile_cont(text_chars, 0.5) as p50, quantile_cont(text_chars, 0.9) as p90 from live where text_chars > 0 group by 1, 2")
def panel_response_sizes(t):
    """Sizes of answers that aren't empty, by bucket and model."""
    out = panels.response_sizes(stored(t), panels.View(SINCE, 86400))
    return out.select(sec("bucket").alias("bucket"), "model", "n", "p50", "p90")


@query("select lang, count(*) as n, quantile_cont(length(text), 0.5) as p50, quantile_cont(length(text), 0.9) as p90 from documents where length(text) > 0 group by 1")
def response_sizes_by_lang(t):
    """Sizes of texts that aren't empty."""
    rows = t("documents").select("lang", F.length("text").alias("chars"), F.lit(SINCE).alias("ts")).where("chars > 0")
    return buckets.percentiles(rows, "ts", 86400, ["lang"], "chars", (0.5, 0.9)).drop("bucket")


def _sessions(v: panels.View) -> str:
    return f"""{STORED}, {_source(v)}, m as (select session_id, model, model not in ('unknown', '<synthetic>') as real, sum(requests)::bigint as requests, {_SUMS}, sum(cost_usd) as cost_usd, min(first_ts) as a, max(last_ts) as b from src group by 1, 2),
    s as (select session_id, epoch_us(min(a)) // 1000000 as start_s, epoch_us(max(b)) // 1000000 as end_s, sum(requests)::bigint as requests, sum(fresh_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cache_creation_tokens)::bigint as cache_create_tokens, sum(cache_read_tokens)::bigint as cache_read_tokens, sum(cost_usd) as cost,
      arg_max(model, struct_pack(x := real, y := requests, z := model)) as model, coalesce(array_to_string(list_sort(list(distinct model) filter (where real)), ','), '') as models_used from m group by 1),
    k as (select session_id, max(last) as ctx_at_end from (select file_key, arg_max(input, idx) as last from turns group by 1) join files using (file_key) where is_main group by 1)
    select s.* exclude (cost), round(cost, 6) as cost, ctx_at_end from s left join k using (session_id) order by round(cost, 6) desc, session_id limit 25"""


def _session_rows(t, v):
    out = panels.sessions(stored(t), v, 25)
    return out.select("session_id", sec("start").alias("start_s"), sec("end").alias("end_s"), "requests", "input_tokens", "output_tokens", "cache_create_tokens", "cache_read_tokens", r("cost_usd", 6).alias("cost"), "model", F.array_join("models_used", ",").alias("models_used"), "ctx_at_end")


@query(_sessions(ROLLED))
def sessions_by_cost(t):
    """Sums by session and model, then by session; the dearest sessions with what their context ended at."""
    return _session_rows(t, ROLLED)


@query(_sessions(LIVE))
def sessions_by_cost_live(t):
    """The same from requests."""
    return _session_rows(t, LIVE)


@query(f"""{STORED}, {_source(PART)} select session_id, coalesce(array_to_string(list_sort(list(distinct model) filter (where model not in ('unknown', '<synthetic>'))), ','), '') as models from src group by 1""")
def models_used(t):
    """Different real models of each session, as one text."""
    return panels.sessions(stored(t), PART, None).select("session_id", F.array_join("models_used", ",").alias("models"))


_SCOPE = f"scope as (select * from files where last_modified >= {_SINCE})"
_MODE = f"""{_SCOPE}, c as (select file_key, model, count(*) as n, model not in ('', '<synthetic>') as real from records where model <> '' group by 1, 2), d as (select file_key, arg_max(model, struct_pack(a := real, b := n, c := -idx)) as model from (select *, row_number() over (partition by file_key order by model) as idx from c) group by 1)"""


@query(f"{STORED}, {_MODE} select file_key, model from d join (select distinct file_key from turns) using (file_key) join scope using (file_key)")
def dominant_model(t):
    """The most frequent real model of each file; the alphabetically first of several."""
    return panels.ctx_traces(stored(t), ROLLED).where("model <> ''").select("file_key", "model")


@query(f"{STORED}, {_MODE} select file_key, session_id, is_main, coalesce(model, '') as model, count(*) as n, sum(input)::bigint as input, sum(delta)::bigint as delta from turns join scope using (file_key) left join d using (file_key) group by 1, 2, 3, 4")
def panel_ctx_traces(t):
    """Context turns of each file in range, with its model."""
    out = panels.ctx_traces(stored(t), ROLLED)
    total = lambda c: F.aggregate("ctx_turns", F.lit(0).cast("long"), lambda a, x: a + x[c]).alias(c)
    return out.select("file_key", "session_id", "is_main", "model", F.size("ctx_turns").cast("long").alias("n"), total("input"), total("delta"))


@query(f"{STORED}, {_SCOPE} select h.session_id, epoch_us(ts) // 1000000 as at_s, content from hits h join scope using (file_key) where ts >= {_SINCE}")
def panel_rate_limit_hits(t):
    """Hits in range; malformed times are left out."""
    return panels.rate_limit_hits(stored(t), ROLLED).select("session_id", sec("ts").alias("at_s"), "content")


_COUNTS = f"""{STORED}, {_SCOPE}, {_source(ROLLED)}, n as (select file_key, count(*) as k from turns group by 1), x as (select s.*, exists (select 1 from records r where r.file_key = s.file_key) as used, exists (select 1 from files f where f.session_id = s.session_id and f.is_main) as has_main, coalesce(k, 0) as turn_count from scope s left join n using (file_key)),
    y as (select count(*) filter (where is_main and used) as main_w_usage, count(*) filter (where is_main and not used) as main_empty, count(*) filter (where not is_main) as subagent_files, count(distinct session_id) filter (where not has_main and used) as subagent_only_sessions, coalesce(sum(prompt_count), 0)::bigint as total_prompts, coalesce(sum(turn_count), 0)::bigint as total_turns from x)"""


@query(f"{_COUNTS} select (select count(distinct session_id) from src) as total_sessions, * from y")
def file_counts(t):
    """Filtered and distinct counts in one pass."""
    return panels.counters(stored(t), ROLLED)


@query(f"{_COUNTS} select main_w_usage, main_empty, subagent_only_sessions from y")
def files_with_records(t):
    """Main files that have records, those that have none, and sessions of other files only."""
    return panels.counters(stored(t), ROLLED).select("main_w_usage", "main_empty", "subagent_only_sessions")


_CUT = {"claude-haiku-4-5": [(datetime(2024, 1, 15, tzinfo=UTC), (2.0, 2.5, 4.0, 0.2, 10.0))]}
_PRICE = {"claude-opus-4-7": (5.0, 6.25, 10.0, 0.5, 25.0), "claude-sonnet-4-5": (3.0, 3.75, 6.0, 0.3, 15.0), "claude-haiku-4-5-20251001": (1.0, 1.25, 2.0, 0.1, 5.0)}


def _parts(dated: bool) -> str:
    def rate(k: int) -> str:
        old = f" when model = 'claude-haiku-4-5-20251001' and ts < timestamp '2024-01-15' then {_CUT['claude-haiku-4-5'][0][1][k]}" if dated else ""
        return f"case{old} " + " ".join(f"when model = '{m}' then {p[k]}" for m, p in _PRICE.items()) + f" else {_PRICE['claude-opus-4-7'][k]} end / 1e6"

    counts = "fresh_tokens", "(eph5_tokens + greatest(0, cache_creation_tokens - eph5_tokens - eph1h_tokens))", "eph1h_tokens", "cache_read_tokens", "output_tokens"
    return ", ".join(f"sum({c} * {rate(k)}) as {n}_cost" for k, (c, n) in enumerate(zip(counts, ("fresh", "create_5m", "create_1h", "read", "output"), strict=True)))


_CACHE = f"""per as (select model, count(*) as requests, {_SUMS}, {_parts(True)}, 100.0 * sum(cache_read_tokens) / sum(fresh_tokens + cache_creation_tokens + cache_read_tokens) as hit_rate, model in ('', '<synthetic>') as estimated from live group by 1)"""
_COSTS = "fresh_cost", "create_5m_cost", "create_1h_cost", "read_cost", "output_cost"


@query(f"""{STORED}, {_LIVE}, {_CACHE} select model, requests, fresh_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, eph5_tokens, eph1h_tokens, {", ".join(f"round({c}, 6) as {c}" for c in _COSTS)}, round({" + ".join(_COSTS)}, 6) as cost, round(hit_rate, 4) as hit_rate, estimated from per""")
def panel_cache(t):
    """Tokens and cost by part for each model, with rates that change in the range."""
    out = panels.cache_per_model(stored(t), ROLLED, _CUT)
    return out.select("model", "requests", *rollups.TOKENS, *(r(c, 6).alias(c) for c in (*_COSTS, "cost")), r("hit_rate").alias("hit_rate"), "estimated")


@query(f"""{STORED}, {_LIVE}, {_CACHE} select sum(requests)::bigint as requests, {_SUMS}, round(sum({" + ".join(_COSTS)}), 6) as cost, bool_or(estimated) as estimated, round(100.0 * sum(cache_read_tokens) / sum(fresh_tokens + cache_creation_tokens + cache_read_tokens), 4) as hit_rate from per""")
def panel_cache_total(t):
    """The same for all models."""
    out = panels.cache_total(panels.cache_per_model(stored(t), ROLLED, _CUT))
    return out.select("requests", *rollups.TOKENS, r("cost", 6).alias("cost"), "estimated", r("hit_rate").alias("hit_rate"))


@query(f"""{STORED}, {_LIVE}, per as (select model, {_SUMS}, {_parts(False)} from live group by 1), u as (select 'input' as category, fresh_tokens as tokens, fresh_cost as cost from per union all select 'output', output_tokens, output_cost from per union all select 'cache_5m', cache_creation_tokens - eph1h_tokens, create_5m_cost from per
    union all select 'cache_1h', eph1h_tokens, create_1h_cost from per union all select 'cache_read', cache_read_tokens, read_cost from per) select category, sum(tokens)::bigint as tokens, round(sum(cost), 6) as cost, round(sum(tokens) / sum(sum(tokens)) over (), 6) as share from u group by 1""")
def token_breakdown(t):
    """Sums turned into rows, with shares."""
    return panels.token_breakdown(stored(t), ROLLED).select("category", "tokens", r("cost", 6).alias("cost"), r("share", 6).alias("share"))


def _top(by: str, more: str = "") -> str:
    return f"{STORED}, {_LIVE} select file_key, line_num, session_id, {by} as tokens from live where true{more} order by {by} desc, file_key, line_num limit 10"


@query(_top("output_tokens"))
def topk_output(t):
    """The requests with the most output, ties by key."""
    return panels.top_requests(stored(t), ROLLED, "output_tokens").select("file_key", F.col("line_num").cast("long").alias("line_num"), "session_id", F.col("output_tokens").alias("tokens"))


@query(_top("cache_creation_tokens", " and cache_creation_tokens > 0"))
def topk_cache_writes(t):
    """The requests that wrote most to the cache."""
    return panels.top_requests(stored(t), ROLLED, "cache_creation_tokens").select("file_key", F.col("line_num").cast("long").alias("line_num"), "session_id", F.col("cache_creation_tokens").alias("tokens"))


@query(_top("cache_read_tokens", " and cache_read_tokens > 0"))
def topk_cache_reads(t):
    """The requests that read most from the cache."""
    return panels.top_requests(stored(t), ROLLED, "cache_read_tokens").select("file_key", F.col("line_num").cast("long").alias("line_num"), "session_id", F.col("cache_read_tokens").alias("tokens"))


def _only(v: panels.View) -> str:
    return (f" and project_id = '{v.project}'" if v.project else "") + (f" and model like '%{v.model}%'" if v.model else "")


@each(lambda v: f"{STORED} select {center(v.width, 'hour')} as bucket, tool_name as tool, sum(n_total)::bigint as n from tools where hour >= date_trunc('hour', {_SINCE}){_only(v)} group by 1, 2" if v.rolled else f"{STORED} select {center(v.width)} as bucket, tool_name as tool, count(*) as n from called join files using (file_key) where ts >= {_SINCE} group by 1, 2")
def panel_tool_usage(t, v):
    """Calls by bucket and tool."""
    return panels.tool_usage(stored(t), v).select(sec("bucket").alias("bucket"), "tool", "n")


@each(lambda v: f"{STORED} select {center(v.width, 'hour')} as bucket, model, tool_name as tool, sum(n_rated)::bigint as n_total, sum(n_error)::bigint as n_error from tools where model <> '' and hour >= date_trunc('hour', {_SINCE}){_only(v)} group by 1, 2, 3 having sum(n_rated) > 0" if v.rolled
      else f"{STORED} select {center(v.width)} as bucket, model, tool_name as tool, count(*) as n_total, count(*) filter (where is_error) as n_error from called join files using (file_key) where is_error is not null and model is not null and ts >= {_SINCE} group by 1, 2, 3")
def panel_tool_error_rate(t, v):
    """Rated and failed calls by bucket, model and tool."""
    return panels.tool_error_rate(stored(t), v).select(sec("bucket").alias("bucket"), "model", "tool", F.col("n_total").cast("long").alias("n_total"), F.col("n_error").cast("long").alias("n_error"))


@query("select lang, count(*) as n_total, count(toxic) as n_rated, count(*) filter (where toxic = 1) as n_error from documents left join labels using (doc_id) group by 1 having count(toxic) > 0")
def tri_state_rate(t):
    """Rates over what has a result; what has none counts in the total only."""
    calls = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "toxic"), "doc_id", "left")
    calls = calls.select(F.lit("f").alias("file_key"), F.lit("r").alias("request_id"), F.lit(SINCE).alias("ts"), F.col("lang").alias("tool_name"), (F.col("toxic") == 1).alias("is_error"), F.lit(0).alias("lines_added"), F.lit(0).alias("lines_deleted"), F.lit(1).alias("line_num"))
    one = calls.sparkSession.createDataFrame([("f", 1, "r", "m", "p")], "file_key string, line_num int, request_id string, model string, project_id string")
    return rollups.tools(calls, one, one).where("n_rated > 0").select(F.col("tool_name").alias("lang"), "n_total", "n_rated", "n_error")


@each(lambda v: f"{STORED}, {_source(v)} select isodow(l)::bigint as dow, hour(l)::bigint as hour, sum(requests)::bigint as requests, sum(output_tokens)::bigint as output_tokens, round(sum(cost_usd), 6) as cost from (select *, (hour at time zone 'UTC') at time zone 'Europe/Prague' as l from src) group by 1, 2")
def panel_heatmap(t, v):
    """Requests, tokens and cost by weekday and hour."""
    return panels.activity_heatmap(stored(t), v).select(F.col("dow").cast("long").alias("dow"), F.col("hour").cast("long").alias("hour"), "requests", "output_tokens", r("cost", 6).alias("cost"))


_NARROW = panels.View(SINCE, 7200)


@query(f"{STORED}, {_WAITS} select {center(21600)} as bucket, model, count(*) as n, {_BANDS} from both_ where project_id = '' group by 1, 2 having {center(21600)} >= {center(21600, _SINCE)}")
def panel_reply_latency(t):
    """Bands from the rollup, where it keeps the width."""
    return panels.reply_latency(stored(t), ROLLED).select(sec("bucket").alias("bucket"), "model", "n", *(r(p).alias(p) for p in ("p10", "p50", "p90")))


@query(f"{STORED}, {_WAITS} select {center(7200)} as bucket, model, count(*) as n, {_BANDS} from waits where project_id = 'p3' and model like '%opus%' and ts >= {_SINCE} group by 1, 2")
def panel_reply_latency_live(t):
    """Bands of another width from the requests, of one project and model."""
    out = panels.reply_latency(stored(t), panels.View(SINCE, 7200, project="p3", model="opus"))
    return out.select(sec("bucket").alias("bucket"), "model", "n", *(r(p).alias(p) for p in ("p10", "p50", "p90")))


@query(f"""{STORED}, {_WAITS}, o as (select *, count(*) over w as n, row_number() over (partition by {center(WIDE)}, model order by x desc, file_key, line_num) as hi, row_number() over (partition by {center(WIDE)}, model order by x, file_key, line_num) as lo from waits where ts >= {_SINCE} window w as (partition by {center(WIDE)}, model))
    select model, epoch_us(ts) // 1000000 as at_s, x as latency_s, file_key, line_num, case when hi <= ceil(n * 0.01) then 'high' else 'low' end as kind from o where n >= 100 and (hi <= ceil(n * 0.01) or lo <= ceil(n * 0.01))""")
def panel_latency_outliers(t):
    """The outliers of a panel as rows."""
    out = panels.latency_outliers(panels.reply_latency(stored(t), panels.View(SINCE, WIDE)))
    return out.select("model", sec("ts").alias("at_s"), "latency_s", "file_key", F.col("line_num").cast("long").alias("line_num"), "kind")


@query(f"{STORED} select model, count(*) as n from records where model <> '' and model <> '<synthetic>' group by 1")
def panel_models(t):
    """Models by number of requests."""
    return panels.models(stored(t))


@query(f"{STORED}, f as (select project_id, count(distinct session_id) as session_count from files group by 1), a as (select project_id, sum(cost_usd) as ever from usage group by 1), {_source(ROLLED)}, b as (select project_id, sum(cost_usd) as now from src group by 1) select project_id, project_id as display_name, session_count, round(coalesce(now, 0), 6) as total_cost from f join a using (project_id) left join b using (project_id) where ever <> 0")
def project_listing(t):
    """Aggregates before they are joined, so that nothing is counted twice."""
    return panels.projects(stored(t), ROLLED).select("project_id", "display_name", "session_count", r("total_cost", 6).alias("total_cost"))


@query(f"""{STORED}, {_SCOPE}, g as (select file_key, count(*)::double as turns, arg_max(input, idx)::double as final from turns join scope using (file_key) where is_main group by 1), u as (select 'turns' as what, turns as x from g union all select 'final', final from g)
    select what, count(*) as n, trunc(avg(x))::bigint as mean, quantile_cont(x, 0.5) as p50, quantile_cont(x, 0.9) as p90, quantile_cont(x, 0.99) as p99, max(x) as max from u group by 1""")
def ctx_growth_stats(t):
    """Turn counts and final inputs of main files."""
    return panels.context_growth(stored(t), ROLLED)


@query(f"{STORED} select session_id, count(*) as total, arg_max(input, idx) as final, sum(output)::bigint as output from turns join files using (file_key) where is_main and session_id in ('s1', 's7') group by 1")
def panel_session_context(t):
    """The context turns of single sessions."""
    s = stored(t)
    one = lambda k: panels.session_context(s, k).where("total > 0").select("session_id", F.col("total").cast("long").alias("total"), "final", F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["output"]).alias("output"))
    return one("s1").union(one("s7"))


def _listed(more: str, order: str, n: int) -> str:
    return f"""{STORED}, m as (select session_id, project_id, model, count(*) as n, min(ts) as a, max(ts) as b, {_SUMS}, sum(cost_usd)::double as cost from own where is_canonical{more} group by 1, 2, 3),
    s as (select session_id, project_id, min(a) as a, max(b) as b, sum(n)::bigint as requests, sum(fresh_tokens)::bigint as fresh_tokens, sum(output_tokens)::bigint as output_tokens, round(sum(cost), 6) as cost, string_agg(model || '=' || n, ',' order by model) as models from m group by 1, 2)
    select session_id, project_id, epoch_us(a) // 1000000 as first_s, epoch_us(b) // 1000000 - epoch_us(a) // 1000000 as duration_s, requests, fresh_tokens, output_tokens, cost, models from s {order} limit {n}"""


def _list_rows(df: DataFrame) -> DataFrame:
    models = F.array_join(F.transform(F.array_sort(F.map_entries("models")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return df.select("session_id", "project_id", sec("first_event_at").alias("first_s"), "duration_s", "requests", "fresh_tokens", "output_tokens", r("cost_usd", 6).alias("cost"), models.alias("models"))


@query(_listed("", "order by a desc, session_id", 11))
def session_page(t):
    """The latest sessions, with their models."""
    return _list_rows(panels.session_list(stored(t), limit=10))


@query(_listed(" and project_id = 'p3'", "where a < timestamp '2024-01-02' or a = timestamp '2024-01-02' and session_id > 's3' order by a desc, session_id", 26))
def keyset_page(t):
    """A page of one project after a cursor of time and key."""
    return _list_rows(panels.session_list(stored(t), "p3", 25, (datetime(2024, 1, 2, tzinfo=UTC), "s3")))


@each(lambda v: _listed("", f"order by {v} desc, session_id", 21), (("_cost", "cost"), ("_output", "output_tokens")))
def sessions_sorted_by(t, v):
    """Sessions by another column, ties by key."""
    return _list_rows(panels.session_list(stored(t), limit=20, sort={"cost": "cost_usd"}.get(v, v)))


@query(f"""{STORED}, d as (select * from own where is_main and session_id in ('s1', 's4')), m as (select session_id, model, count(*) as n from d group by 1, 2)
    select session_id, min(project_id) as project_id, sum(fresh_tokens)::bigint as fresh_tokens, round(sum(cost_usd)::double, 6) as cost, (select arg_max(model, struct_pack(a := n, b := model)) from m where m.session_id = d.session_id) as model, (select string_agg(model || '=' || n, ',' order by model) from m where m.session_id = d.session_id) as models,
      epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 as duration_s, round(sum(output_tokens) / (epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000), 6) as tps from d group by 1""")
def session_detail(t):
    """Single sessions' main files, repeats included."""
    s = stored(t)
    out = panels.session_detail(s, "s1").union(panels.session_detail(s, "s4")).where("fresh_tokens is not null")
    models = F.array_join(F.transform("models", lambda e: F.concat_ws("=", e["model"], e["n"].cast("string"))), ",")
    return out.select("session_id", "project_id", "fresh_tokens", r("cost_usd", 6).alias("cost"), "model", models.alias("models"), "duration_s", r("tps", 6).alias("tps"))


# Reports

_FROM, _TO = datetime(2024, 1, 4, tzinfo=UTC), datetime(2024, 1, 20, 12, tzinfo=UTC)
_ONCE = f"""once as (select distinct on (k) *, case when starts_with(model, 'claude-') then regexp_replace(replace(model, 'claude-', ''), '-[0-9]{{8}}$', '') else model end as short from (select *, coalesce(uuid, file_key || ':' || line_num) as k from own where ts is not null and ts between timestamp '2024-01-04' and timestamp '2024-01-20 12:00:00') order by k, ts, file_key, line_num)"""


def _requests(t) -> DataFrame:
    return timeline.requests(stored(t), _FROM, _TO)


@query(f"{STORED}, {_ONCE} select short as model, count(*) as calls, round(sum(cost_usd)::double, 6) as cost, sum(fresh_tokens)::bigint as input from once group by 1")
def report_cost_and_calls(t):
    """Calls and cost by model, each request once."""
    rows = _requests(t)
    tokens = rows.groupBy("model").agg(F.sum("input").alias("input"))
    return timeline.cost_and_calls(rows).join(tokens, "model").select("model", "calls", r("cost", 6).alias("cost"), "input")


@query(f"""{STORED}, {_ONCE}, b as (select unnest(range(0, 99)) as bin), x as (select least(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-04')) / 14400e6), 98)::bigint as bin, count(*) as n, sum(output_tokens)::bigint as output, sum(cost_usd)::double as cost from once group by 1)
    select bin, coalesce(n, 0) as n, coalesce(output, 0) as output, round(coalesce(cost, 0), 6) as cost, sum(coalesce(output, 0)) over (order by bin)::bigint as cum_output from b left join x using (bin)""")
def report_bars(t):
    """Bars from the range's start with running sums."""
    out = timeline.bars(_requests(t), _FROM, _TO)
    return out.select("bin", "n", F.col("output").cast("long").alias("output"), r("cost", 6).alias("cost"), F.col("cum_output").cast("long").alias("cum_output"))


_FLAT = "list_transform(range(1, len(l) + 1), lambda k: list_reduce(list_transform(l[1:k], lambda x: x.v), lambda acc, x: {b} * acc + {a} * x))"
_GAPS = f"""{_ONCE}, g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) > 1800e6 or lag(ts) over w is null then 1 else 0 end as new from once window w as (order by ts, file_key, line_num)), s as (select *, sum(new) over (order by ts, file_key, line_num rows unbounded preceding)::bigint as session_no from g)"""
_RATES = f"""{_GAPS}, x as (select session_no, min(ts) as a, max(ts) as b, count(*) as events, sum(output_tokens)::double as output, sum(cost_usd)::double as cost from s group by 1 having count(*) >= 3), h as (select *, greatest((epoch_us(b) - epoch_us(a)) / 1e6, 60) / 3600 as dur_h from x),
    y as (select list(struct_pack(i := session_no, v := output / dur_h) order by a, session_no) as l from h), e as (select unnest(list_transform(l, lambda x: x.i)) as session_no, unnest({_FLAT.format(a=0.15, b=0.85)}) as output_ema from y), m as (select session_no, short, count(*) as n from s group by 1, 2)"""


@query(f"{STORED}, {_RATES} select h.session_no, events, round(dur_h, 6) as dur_h, round(output / dur_h, 3) as output_per_h, round(output_ema, 3) as output_ema, round(100 * cost / dur_h, 4) as cost_per_100h, (select arg_max(short, struct_pack(a := n, b := short)) from m where m.session_no = h.session_no) as primary_model from h join e using (session_no)")
def report_burn_rates(t):
    """Sessions by pauses, tokens for an hour, smoothed over sessions."""
    out = timeline.burn_rates(_requests(t))
    return out.select("session_no", "events", r("dur_h", 6).alias("dur_h"), r("output_per_h", 3).alias("output_per_h"), r("output_ema", 3).alias("output_ema"), r("cost_per_100h").alias("cost_per_100h"), "primary_model")


@query(f"{STORED}, {_GAPS}, n as (select *, min(ts) over w as a, max(ts) over w as b, count(*) over w as n from s window w as (partition by session_no)), k as (select *, floor((epoch_us(ts) - epoch_us(a)) / 1800e6)::bigint as slice from n where n >= 3 and ts < b), x as (select session_no, slice, any_value(a) as a, any_value(b) as b, sum(output_tokens)::double as output from k group by 1, 2), z as (select *, least(1800.0, (epoch_us(b) - epoch_us(a)) / 1e6 - slice * 1800) as len from x) select session_no, slice, round(output / (greatest(len, 60.0) / 3600), 3) as output_per_h from z")
def report_slices(t):
    """Rates within sessions."""
    return timeline.slices(_requests(t)).select("session_no", "slice", r("output_per_h", 3).alias("output_per_h"))


@query(f"{STORED}, {_ONCE}, g as (select ts, lag(ts) over (order by ts) as p from once) select epoch_us(ts) // 1000000 as boundary from g where epoch_us(ts) - epoch_us(p) >= 3600e6")
def report_boundaries(t):
    """Where long pauses lie, here of an hour."""
    return timeline.boundaries(_requests(t), gap_s=3600).select(sec("boundary").alias("boundary"))


_GREEDY = "list_reduce(list_prepend([]::bigint[], list_transform(l, lambda x: [x])), lambda acc, x: case when len(acc) = 0 or x[1] - acc[len(acc)] > {gap} then list_concat(acc, x) else acc end)"


@query(f"{STORED}, l as (select list(epoch_us(ts) order by ts, content) as l from hits where ts between timestamp '2024-01-04' and timestamp '2024-01-20 12:00:00') select unnest({_GREEDY.format(gap=36000000000)}) // 1000000 as at_s from l")
def report_limit_hits(t):
    """Limit hits, those soon after one that was kept left out."""
    return timeline.limit_hits(stored(t), _FROM, _TO, 36000).select(sec("ts").alias("at_s"))


@query(f"""{STORED}, {_source(ROLLED)}, b as (select {center(21600, "hour")} as bucket, 100.0 * sum(eph5_tokens) / sum(eph5_tokens + eph1h_tokens) as share from src group by 1 having sum(eph5_tokens + eph1h_tokens) > 0), l as (select list(share order by share) as l from b)
    select len(l)::bigint as n, round(l[least(len(l) - 1, floor(len(l) * 0.5)::bigint) + 1], 6) as q50, round(l[least(len(l) - 1, floor(len(l) * 0.95)::bigint) + 1], 6) as q95 from l""")
def report_short_cache_share(t):
    """The share of cache writes kept five minutes, over buckets."""
    return timeline.short_cache_share(panels.hourly(stored(t), ROLLED)).select("n", r("q50", 6).alias("q50"), r("q95", 6).alias("q95"))


@query(f"{STORED}, {_SCOPE}, s as (select idx, list(input order by input) as l from turns join scope using (file_key) group by 1) select idx, len(l)::bigint as n, " + ", ".join(f"l[least(len(l) - 1, floor(len(l) * {q})::bigint) + 1] as q{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.9)) + " from s")
def report_turn_growth(t):
    """Context by turn over all files."""
    out = timeline.turn_growth(panels.ctx_traces(stored(t), ROLLED))
    return out.withColumn("idx", F.col("idx").cast("long"))


@query(f"""{STORED}, c as (select {center(86400)} as bucket, tool_name as k, count(*) as n, count(*) filter (where is_error) as e from called where is_error is not null and ts is not null group by 1, 2), top as (select k from c group by 1 order by sum(n) desc, 1 limit 2), f as (select bucket, coalesce(top.k, 'Other') as s, n, e from c left join top on c.k = top.k),
    a as (select bucket, s, sum(n) as n, sum(e) as e from (select * from f union all select bucket, 'Aggregate', n, e from f) group by 1, 2), y as (select s, list(struct_pack(i := bucket, v := e / n) order by bucket) as l from a group by 1) select s as series, unnest(list_transform(l, lambda x: x.i)) as bucket, round(unnest({_FLAT.format(a=0.15, b=0.85)}), 6) as rate_ema from y""")
def report_error_trend(t):
    """Smoothed error rates of all tools, the most used ones and the others."""
    calls = stored(t).tool_uses.where("is_error is not null and ts is not null").groupBy(sec(time.bucket_center(F.col("ts"), 86400)).alias("bucket"), F.col("tool_name").alias("tool")).agg(F.count("*").alias("n_total"), F.count_if("is_error").alias("n_error"))
    return timeline.error_trend(calls, 2).select("series", "bucket", r("rate_ema", 6).alias("rate_ema"))


@query("select event_type, sum(cast(json_extract(props, '$.k') as bigint))::bigint as k from events group by 1")
def json_field_sum(t):
    """A field of JSON texts, summed."""
    rows = t("events").select("event_type", F.expr("try_parse_json(props)").alias("v"))
    return rows.groupBy("event_type").agg(F.sum(transcript.field("v", "$.k", "bigint")).alias("k"))


# Series as they are drawn


@query("""with g as (select user_id, event_id as x, value as y, row_number() over w as i, count(*) over (partition by user_id) as n, lead(value) over w as a, lag(value) over w as b from events window w as (partition by user_id order by event_id))
    select user_id, x::double as x, round(y, 6) as y from g union all select user_id, x - 5.0, round(greatest(0, 1.5 * y - 0.5 * coalesce(a, y)), 6) from g where i = 1 union all select user_id, x + 5.0, round(greatest(0, 1.5 * y - 0.5 * coalesce(b, y)), 6) from g where i = n""")
def drawn_edges(t):
    """Series drawn to the outer borders of their buckets."""
    return series.edges(t("events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 5).select("user_id", F.col("event_id").alias("x"), r("value", 6).alias("y"))


@query("""with g as (select user_id, event_id as x, value as y, row_number() over w as i, count(*) over (partition by user_id) as n, lead(value) over w as a, lag(value) over w as b from events window w as (partition by user_id order by event_id))
    select user_id, x::double as x, round(y, 6) as y from g union all select user_id, x - 5.0, round(pow(10, 1.5 * log10(y) - 0.5 * log10(coalesce(a, y))), 6) from g where i = 1 union all select user_id, x + 5.0, round(pow(10, 1.5 * log10(y) - 0.5 * log10(coalesce(b, y))), 6) from g where i = n""")
def drawn_log_edges(t):
    """The same on a logarithmic scale."""
    return series.edges(t("events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 5, log=True).select("user_id", F.col("event_id").alias("x"), r("value", 6).alias("y"))


@query("select event_id, round(value / sum(value) over (partition by event_id % 100), 8) as share from events")
def drawn_shares(t):
    """Shares that sum to one at each place."""
    out = series.renormalised(t("events").select("event_id", (F.col("event_id") % 100).alias("x"), "value"), "x", "value")
    return out.select("event_id", r("value", 8).alias("share"))


@query("""with g as (select user_id, event_id::double as x, value as y, lead(event_id) over w as x2, lead(value) over w as y2 from events window w as (partition by user_id order by event_id))
    select user_id, round(x + coalesce(x2 - x, 0) * k / 4, 6) as x, round(y + coalesce(y2 - y, 0) * k / 4, 6) as y from g, (select unnest(range(0, 4)) as k) where x2 is not null or k = 0""")
def drawn_densified(t):
    """Points on the straight lines between neighbours."""
    out = series.densified(t("events").select("user_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y")), ["user_id"], "x", "y", 4)
    return out.select("user_id", r("x", 6).alias("x"), r("y", 6).alias("y"))


@query(f"{STORED} select file_key, idx, input, delta from turns union all select distinct file_key, 0, 0, 0 from turns")
def drawn_traces(t):
    """Turns with an origin of zeros before each series."""
    turns = stored(t).files.select("file_key", F.explode("ctx_turns").alias("x")).select("file_key", "x.*")
    return series.traces(turns, ["file_key"], ["input", "delta"]).withColumn("idx", F.col("idx").cast("long"))


@query("select user_id, count(*) as n, round(greatest(0.15, 2.0 / (count(*) + 1)), 6) as alpha from events group by 1")
def drawn_alpha(t):
    """The smoothing that a series is drawn with."""
    return timeline.smoothed_alpha(t("events"), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("alpha"), 6).alias("alpha"))


@query("""with w as (select event_type as k, sum(value) as v from events group by 1), g as (select *, row_number() over (order by v desc, k) as rn from w), f as (select event_type, value, case when rn <= 2 then k else 'Other' end as s from events join g on event_type = k) select s as event_type, count(*) as n, round(sum(value), 4) as total from f group by 1""")
def top_or_other(t):
    """The largest keys by themselves, the others as one."""
    return series.top_or_other(t("events"), "event_type", "value", 2).groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


def updated(t) -> panels.Tables:
    """The stored tables after two updates: the first knows some files not yet, others with rows that change, and some that
    vanish; the second brings what differs, and only that."""
    files, records, tool_uses = parsed(t)
    files = tables.written(files, "files")  # both updates read it
    user = F.regexp_extract("file_key", r"/f(\d+)$", 1).cast("int")
    spark, out = files.sparkSession, tables.work_folder(files.sparkSession, "updates")
    late, other = user % 7 == 0, user % 5 == 1
    renamed = lambda df: df.where(user % 11 == 3).withColumn("file_key", F.concat(F.col("file_key"), F.lit("-old")))
    early = lambda df, same: df.where(~late).withColumns(same).unionByName(renamed(df))
    first = (
        early(files, {}),
        early(records.where(~other | (F.col("line_num") % 3 > 0)), {"fresh_tokens": F.when(other, F.col("fresh_tokens") + 1).otherwise(F.col("fresh_tokens")), "ts": F.when(other, F.col("ts") - F.expr("interval 30 hours")).otherwise(F.col("ts"))}),
        early(tool_uses.where(~other | (F.col("line_num") % 2 > 0)), {"lines_added": F.when(other, F.lit(1)).otherwise(F.col("lines_added")).cast(tool_uses.schema["lines_added"].dataType)}),
    )
    none = files.select("file_key").limit(0)
    incremental.apply(versions.latest(spark, out), *first, none, f"{out}/_work/1").commit()
    change = [df.where(late | other) for df in (files, records, tool_uses)]
    made = incremental.apply(versions.latest(spark, out), *change, renamed(files).select("file_key"), f"{out}/_work/2").commit()
    return panels.Tables(*(made.read(k) for k in ("files", "records", "tool_uses", "usage", "tools", "latency")))


@query(f"{STORED} select 'usage' as kind, epoch_us(hour) // 1000000 as hour, project_id, session_id || case when is_main then ' main' else '' end as session_id, model, requests as n, fresh_tokens as a, output_tokens as b, round(cost_usd, 4) as c, epoch_us(first_ts) // 1000000 as d from usage union all select 'tools', epoch_us(hour) // 1000000, project_id, tool_name, model, n_total, n_error, lines_added::bigint, lines_deleted::double, n_rated from tools")
def incremental_usage(t):
    """Rollups after an update of what changed only: usage by its groups, tool calls by differences."""
    got = updated(t)
    who = F.concat(F.col("session_id"), F.when(F.col("is_main"), " main").otherwise(""))
    one = got.usage.select(F.lit("usage").alias("kind"), sec("hour").alias("hour"), "project_id", who.alias("session_id"), "model", F.col("requests").alias("n"), F.col("fresh_tokens").alias("a"), F.col("output_tokens").alias("b"), r("cost_usd").alias("c"), sec("first_ts").alias("d"))
    two = got.tools.select(F.lit("tools").alias("kind"), sec("hour").alias("hour"), "project_id", F.col("tool_name").alias("session_id"), "model", F.col("n_total").alias("n"), F.col("n_error").alias("a"), F.col("lines_added").cast("long").alias("b"), F.col("lines_deleted").cast("double").alias("c"), F.col("n_rated").alias("d"))
    return one.unionByName(two)


@query(f"{STORED} select file_key, line_num, coalesce(uuid, '') as uuid, fresh_tokens, coalesce(epoch_us(ts) // 1000000, -1) as at_s, is_canonical from records")
def incremental_canonical(t):
    """Requests after an update of what changed only, with the flag of those that count among copies."""
    return updated(t).records.select("file_key", F.col("line_num").cast("long").alias("line_num"), F.coalesce("uuid", F.lit("")).alias("uuid"), "fresh_tokens", F.coalesce(sec("ts"), F.lit(-1)).alias("at_s"), "is_canonical")


@query(f"""{STORED}, u as (select *, hour < timestamp '2024-01-16' as early from usage) select 'day' as view, date_trunc('day', hour)::date::varchar as k, count(distinct session_id) as session_count from u group by 1, 2
    union all select 'model', model, count(distinct session_id) from u where early group by 1, 2 union all select 'all', '', count(distinct session_id) from u""")
def sessions_from_bitmaps(t):
    """Different sessions by day, by model of a range, and of all, from bitmaps of the rollup alone."""
    usage = stored(t).usage
    maps = tables.written(rollups.session_bitmaps(usage, rollups.session_numbers(usage)), "bitmaps")
    views = ("day", F.to_date("hour").cast("string"), maps), ("model", F.col("model"), maps.where("hour < timestamp '2024-01-16'")), ("all", F.lit(""), maps)
    out = [rollups.sessions_in(rows, [k.alias("k")]).select(F.lit(name).alias("view"), "k", "session_count") for name, k, rows in views]
    return out[0].unionByName(out[1]).unionByName(out[2])
