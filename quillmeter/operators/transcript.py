"""From transcript lines to requests, tool calls, prompts, context turns and limit hits.

Lines are parsed into variants, since their shape is free; everything is grouped and ordered by file. All frames come
from one frame of events, which callers may keep.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions import pricing, text, time
from quillmeter.functions.churn import edit_churn, shell_churn

_COUNTERS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
_CALL = "struct<" + ",".join(f"{c}:bigint" for c in _COUNTERS) + ",cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,server_tool_use:map<string,bigint>>"


def field(variant: str, path: str, kind: str = "string"):
    """A field of a variant column, null if it is missing or of another kind."""
    return F.expr(f"try_variant_get({variant}, '{path}', '{kind}')")


def _is(variant: str, kind: str):
    return F.coalesce(F.expr(f"schema_of_variant({variant})").startswith(kind), F.lit(False))


def events(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """User and assistant lines with typed fields; lines that are no JSON object or of another type are left out. Columns
    of keep stay.

    usable: an assistant line with usage that isn't a stub, a limit error or of the synthetic model.
    """
    parsed = lines.select("file_key", "line_num", *keep, F.expr("try_parse_json(value)").alias("v")).where(_is("v", "OBJECT"))
    out = parsed.select(
        *keep, "file_key", "line_num", field("v", "$.type").alias("type"), F.nullif(field("v", "$.uuid"), F.lit("")).alias("uuid"),
        F.coalesce(field("v", "$.requestId"), F.lit("")).alias("request_id"), F.coalesce(field("v", "$.timestamp"), F.lit("")).alias("ts_text"),
        (_is("try_variant_get(v, '$.isApiErrorMessage', 'variant')", "BOOLEAN") & F.coalesce(field("v", "$.isApiErrorMessage", "boolean"), F.lit(False)) & (F.coalesce(field("v", "$.error"), F.lit("")) == "rate_limit")).alias("limited"),
        F.coalesce(field("v", "$.message.model"), F.lit("")).alias("model"), field("v", "$.message.content", "variant").alias("content"), field("v", "$.message.usage", "variant").alias("usage"),
    ).where(F.col("type").isin("user", "assistant"))
    blocks = F.when(_is("content", "ARRAY"), F.expr("try_cast(content as array<variant>)")).when(_is("content", "STRING"), F.expr("array(to_variant_object(named_struct('type', 'text', 'text', cast(content as string))))"))
    usable = (F.col("type") == "assistant") & ~F.col("limited") & _is("usage", "OBJECT<") & (F.expr("schema_of_variant(usage)") != "OBJECT<>") & (F.col("model") != "<synthetic>")
    return out.withColumns({"blocks": F.coalesce(blocks, F.expr("cast(array() as array<variant>)")), "ts": time.instant(F.col("ts_text")), "usable": F.coalesce(usable, F.lit(False))})


def _texts(blocks: str = "blocks"):
    """The texts of the text blocks."""
    return F.expr(f"transform(filter({blocks}, b -> try_variant_get(b, '$.type', 'string') = 'text'), b -> coalesce(try_variant_get(b, '$.text', 'string'), ''))")


def _calls(usage: str = "usage"):
    """The calls that a line's usage lists, null without a list."""
    return F.expr(f"from_json(to_json(try_variant_get({usage}, '$.iterations', 'variant')), 'array<{_CALL}>')")


def _summed(a, b):
    """Two maps of counts as one, equal keys added."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def usage_columns(usage: str = "usage", listed: str = "_calls") -> dict:
    """Token counts of one line: over all calls if the line lists several, and the largest context of a single call.

    listed is a column with the calls, made beforehand, so that the list is parsed once for a line.
    """
    calls = F.col(listed)
    top = {c: F.coalesce(field(usage, f"$.{c}", "bigint"), F.lit(0)) for c in _COUNTERS}
    several = F.size(F.coalesce(calls, F.array())) > 0
    total = lambda f: F.aggregate(calls, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(f(x), F.lit(0)))
    kept = {k: (lambda x, k=k: x["cache_creation"][f"ephemeral_{k}_input_tokens"]) for k in ("5m", "1h")}
    split = several & F.exists(calls, lambda x: x["cache_creation"].isNotNull())
    out = {c: F.when(several, total(lambda x, c=c: x[c])).otherwise(v) for c, v in top.items()}
    out |= {f"eph{k}": F.when(split, total(f)).otherwise(F.coalesce(field(usage, f"$.cache_creation.ephemeral_{k}_input_tokens", "bigint"), F.lit(0))) for k, f in kept.items()}
    context = lambda x: sum(F.coalesce(x[c], F.lit(0)) for c in _COUNTERS if c != "output_tokens")
    none = F.create_map().cast("map<string,bigint>")
    served = F.aggregate(calls, none, lambda a, x: _summed(a, F.coalesce(x["server_tool_use"], none)))
    out["server_tool_use"] = F.when(several & F.exists(calls, lambda x: x["server_tool_use"].isNotNull()), served).otherwise(F.coalesce(field(usage, "$.server_tool_use", "map<string,bigint>"), none))
    out["calls"] = F.when(calls.isNotNull(), F.size(calls))
    out["peak"] = F.when(F.size(calls) > 1, F.array_max(F.transform(calls, context)))
    return out


def _user_texts(ev: DataFrame) -> DataFrame:
    """(file_key, line_num, pos, ts, kind, replay) of the user's texts; a replay repeats the uuid of an earlier line."""
    first = F.min("line_num").over(Window.partitionBy("file_key", "uuid"))
    users = ev.where("type = 'user'").withColumn("replay", F.col("uuid").isNotNull() & (first < F.col("line_num")))
    each = users.select("file_key", "line_num", "ts", "replay", F.posexplode(_texts()).alias("pos", "text"))
    return each.withColumn("kind", text.prompt_kind(F.col("text"))).drop("text")


def prompts(ev: DataFrame) -> DataFrame:
    """(file_key, line_num), a row for each prompt; a line may hold several."""
    return _user_texts(ev).where("kind = 'prompt'").select("file_key", "line_num")


def latencies(ev: DataFrame) -> DataFrame:
    """(file_key, line_num, latency_s) of replies: since the last dated prompt, if no reply or interruption came between.

    Replays and undated prompts change nothing; every usable line takes the prompt up, and negative waits are dropped.
    """
    last = F.max_by("anchor", "pos")
    marks = _user_texts(ev).where("not replay and (kind = 'interrupt' or kind = 'prompt' and ts is not null)")
    marks = marks.withColumn("anchor", F.when(F.col("kind") == "prompt", F.col("ts"))).groupBy("file_key", "line_num").agg(F.max_by(F.struct("anchor"), "pos")["anchor"].alias("anchor"))
    steps = marks.select("file_key", "line_num", "anchor", F.lit(None).cast("timestamp").alias("ts"), F.lit(False).alias("reply"))
    steps = steps.unionByName(ev.where("usable").select("file_key", "line_num", F.lit(None).cast("timestamp").alias("anchor"), "ts", F.lit(True).alias("reply")))
    before = F.lag("anchor").over(Window.partitionBy("file_key").orderBy("line_num"))
    wait = (F.unix_micros("ts") - F.unix_micros("before")) / 1e6
    out = steps.withColumn("before", before).where("reply")
    return out.select("file_key", "line_num", F.when(wait >= 0, wait).cast("decimal(10,3)").alias("reply_latency_s"))


def records(ev: DataFrame, dated=pricing.DATED) -> DataFrame:
    """One row for each request: lines of one request id in a file are merged, counts by their maximum, identity from the
    first line. Priced with the rates of its time."""
    shown = F.aggregate(_texts(), F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    rows = ev.where("usable").withColumn("_calls", _calls()).select("file_key", "line_num", "uuid", "request_id", "ts", F.when(F.col("model") == "", "(unknown)").otherwise(F.col("model")).alias("model"), shown.alias("text_chars"), *(c.alias(k) for k, c in usage_columns().items()))
    rows = rows.join(latencies(ev), ["file_key", "line_num"])
    group = F.when(F.col("request_id") == "", F.concat(F.lit("#"), F.col("line_num"))).otherwise(F.concat(F.lit("="), F.col("request_id")))
    identity = F.struct("uuid", "request_id", "ts", "model", "reply_latency_s")
    merged = rows.groupBy("file_key", group.alias("request")).agg(
        F.min("line_num").alias("line_num"), F.min_by(identity, "line_num").alias("one"), F.max("text_chars").alias("text_chars"), *(F.max(c).alias(c) for c in (*_COUNTERS, "eph5m", "eph1h")),
        F.expr("min_by(struct(peak), line_num) filter (where calls is not null)").alias("peak"), F.collect_list("server_tool_use").alias("served"),  # a request's lines
    )
    largest = F.aggregate("served", F.create_map().cast("map<string,bigint>"), lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y)))
    read = F.col("cache_read_input_tokens")
    named = merged.select(
        "file_key", "line_num", "one.*", F.col("input_tokens").alias("fresh_tokens"), "output_tokens", F.col("cache_creation_input_tokens").alias("cache_creation_tokens"), read.alias("cache_read_tokens"),
        F.col("eph5m").alias("eph5_tokens"), F.col("eph1h").alias("eph1h_tokens"), "text_chars", F.coalesce("peak.peak", F.col("input_tokens") + F.col("cache_creation_input_tokens") + read).alias("ctx_input"),
        largest.alias("server_tool_use"),
    )
    found = pricing.resolve(F.col("model"), F.col("ts"), dated=dated)
    usd = pricing.cost(F.col("rate.rates"), *(F.col(c) for c in ("fresh_tokens", "cache_creation_tokens", "eph5_tokens", "eph1h_tokens", "cache_read_tokens", "output_tokens")))
    return named.withColumn("rate", found).withColumns({"cost_usd": F.round(usd, 6).cast("decimal(12,6)"), "estimated": F.col("rate.estimated")}).drop("rate")


def tool_uses(ev: DataFrame) -> DataFrame:
    """One row for each tool call, by its id, with is_error (null without a result) and the lines it added and deleted.

    Calls count on every usable line, not only on the first of a request. Failed calls change no lines.
    """
    block = lambda path, kind="string": F.expr(f"try_variant_get(b, '{path}', '{kind}')")
    calls = ev.where("usable").select("file_key", "line_num", "request_id", "ts", F.posexplode("blocks").alias("idx", "b"))
    calls = calls.select("file_key", "line_num", "request_id", "ts", "idx", block("$.type").alias("kind"), F.coalesce(block("$.name"), F.lit("")).alias("tool_name"), F.coalesce(block("$.id"), F.lit("")).alias("id"),
                         block("$.input.command").alias("command"), block("$.input.old_string").alias("old"), block("$.input.new_string").alias("new"), block("$.input.content").alias("body"))
    calls = calls.where("kind in ('tool_use', 'server_tool_use') and tool_name <> ''")
    name = F.when(F.col("id") != "", F.col("id")).otherwise(F.concat_ws(":", "request_id", "line_num", "idx"))
    calls = calls.withColumn("nth", F.row_number().over(Window.partitionBy("file_key", name).orderBy("line_num", "idx"))).where("nth = 1")
    results = ev.where("type = 'user'").select("file_key", "line_num", F.posexplode("blocks").alias("pos", "b"))
    results = results.where(block("$.type") == "tool_result").select("file_key", block("$.tool_use_id").alias("id"), F.coalesce(block("$.is_error", "boolean"), F.lit(False)).alias("is_error"), F.struct("line_num", "pos").alias("at"))
    results = results.where("id <> ''").groupBy("file_key", "id").agg(F.max_by("is_error", "at").alias("is_error"))
    calls = calls.join(results, ["file_key", "id"], "left").withColumn("shell", shell_churn(F.when(F.col("tool_name") == "Bash", F.col("command"))))
    added, deleted = edit_churn(F.col("tool_name"), F.col("old"), F.col("new"), F.col("body"))
    failed = F.coalesce("is_error", F.lit(False))
    lines = lambda own, part: F.when(failed, 0).otherwise(own + F.col(f"shell.{part}")).cast("long")
    return calls.select("file_key", "line_num", "idx", "request_id", "ts", "tool_name", "is_error", lines(added, "added").alias("lines_added"), lines(deleted, "deleted").alias("lines_deleted"))


def limit_hits(ev: DataFrame) -> DataFrame:
    """(file_key, line, ts, content) of replies that say the extra usage is out; ts stays text, it may be malformed."""
    said = F.array_join(_texts(), " ")
    return ev.where("type = 'assistant' and limited").select("file_key", F.col("line_num").alias("line"), F.col("ts_text").alias("ts"), F.substring(said, 1, 500).alias("content")).where(F.lower(said).contains("out of extra usage"))


def context_turns(recs: DataFrame, asked: DataFrame) -> DataFrame:
    """(file_key, idx, ts, line, input, output, delta): the last request before each prompt that follows, in time order.

    Undated requests come first. A prompt ends a turn if it stands at or before the line of the next request in time.
    Turns without input are left out before they are numbered.
    """
    steps = recs.select("file_key", "line_num", "ts", "ctx_input", "output_tokens", F.lit(0).alias("asks"), F.lit(1).alias("rank"))
    nothing = {"ts": F.lit(None).cast("timestamp"), "ctx_input": F.lit(None).cast("long"), "output_tokens": F.lit(None).cast("long")}
    steps = steps.unionByName(asked.select("file_key", "line_num", F.lit(1).alias("asks"), F.lit(0).alias("rank")).withColumns(nothing))
    by_line = Window.partitionBy("file_key").orderBy("line_num", "rank").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("file_key").orderBy(F.col("ts").isNotNull(), "ts", "line_num")
    known = steps.withColumn("asked", F.sum("asks").over(by_line)).where("rank = 1").withColumn("turn", F.max("asked").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(F.col("ts").isNotNull().alias("dated"), "ts", "line_num")
    turns = known.groupBy("file_key", "turn").agg(F.max_by(F.struct("ts", F.col("line_num").alias("line"), F.col("ctx_input").alias("input"), F.col("output_tokens").alias("output")), place).alias("t"))
    turns = turns.select("file_key", "turn", "t.*").where("input > 0")
    w = Window.partitionBy("file_key").orderBy("turn")
    return turns.select("file_key", F.row_number().over(w).alias("idx"), "ts", "line", "input", "output", (F.col("input") - F.lag("input", 1, 0).over(w)).alias("delta"))


def files(listing: DataFrame, asked: DataFrame, turns: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each transcript: listing columns, counts, and its turns and hits as arrays."""
    counts = asked.groupBy("file_key").agg(F.count("*").cast("int").alias("prompt_count"))
    by_file = turns.groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("idx", "ts", "line", "input", "output", "delta"))).alias("ctx_turns"))
    hit = hits.groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("line", "ts", "content"))).alias("rate_limit_hits"))
    out = listing.join(counts, "file_key", "left").join(by_file, "file_key", "left").join(hit, "file_key", "left")
    empty = {"prompt_count": F.coalesce("prompt_count", F.lit(0)), "ctx_turns": F.coalesce("ctx_turns", F.array().cast(by_file.schema["ctx_turns"].dataType)), "rate_limit_hits": F.coalesce("rate_limit_hits", F.array().cast(hit.schema["rate_limit_hits"].dataType))}
    return out.withColumns(empty).withColumn("turn_count", F.size("ctx_turns"))


def browse(lines: DataFrame) -> DataFrame:
    """(file_key, line_num, kind, ts, text): every line as a reader sees it, one row for each block; lines that are no JSON
    are of kind parse_error."""
    v = lines.select("file_key", "line_num", F.expr("try_parse_json(value)").alias("v"), "value")
    kind = F.coalesce(field("v", "$.type"), F.lit("parse_error"))
    content = field("v", "$.message.content", "variant")
    rows = v.select("file_key", "line_num", kind.alias("line_kind"), field("v", "$.timestamp").alias("ts_text"), "value", content.alias("content"), F.coalesce(field("v", "$.content"), F.lit("")).alias("note"))
    one = F.expr("array(to_variant_object(named_struct('type', 'text', 'text', coalesce(try_cast(content as string), note))))")
    rows = rows.withColumn("b", F.explode(F.when(_is("content", "ARRAY"), F.expr("try_cast(content as array<variant>)")).otherwise(one)))
    block = F.expr("try_variant_get(b, '$.type', 'string')")
    shown = F.coalesce(F.expr("try_variant_get(b, '$.text', 'string')"), F.expr("try_variant_get(b, '$.thinking', 'string')"), F.expr("try_variant_get(b, '$.name', 'string')"), F.expr("to_json(try_variant_get(b, '$.content', 'variant'))"))
    agent = F.expr("try_variant_get(b, '$.name', 'string')").isin("Task", "Agent")
    name = F.when(F.col("line_kind").isin("user", "assistant") & (block != "text"), F.when((block == "tool_use") & agent, "agent_spawn").otherwise(block)).otherwise(F.col("line_kind"))
    return rows.select("file_key", "line_num", name.alias("kind"), time.instant(F.col("ts_text")).alias("ts"), F.when(F.col("line_kind") == "parse_error", F.col("value")).otherwise(F.coalesce(shown, F.lit(""))).alias("text"))


def notes(lines: DataFrame) -> DataFrame:
    """(file_key, line_num, kind, ts, name, content) of lines beside the talk: system notes, queue operations, attachments
    and permission modes; a system note about rate limits gives a row of kind rate_limit as well."""
    v = lines.select("file_key", "line_num", F.expr("try_parse_json(value)").alias("v")).withColumn("kind", field("v", "$.type"))
    v = v.where(F.col("kind").isin("system", "queue-operation", "attachment", "permission-mode"))
    of = lambda path: F.coalesce(field("v", path), F.lit(""))
    name = F.when(F.col("kind") == "system", of("$.subtype")).when(F.col("kind") == "queue-operation", of("$.operation")).when(F.col("kind") == "attachment", of("$.attachment.type")).otherwise(of("$.permissionMode"))
    rows = v.select("file_key", "line_num", "kind", time.instant(of("$.timestamp")).alias("ts"), name.alias("name"), of("$.content").alias("content"))
    said = F.lower(F.concat_ws(" ", "content", "name"))
    limited = (F.col("kind") == "system") & (said.contains("rate limit") | said.contains("rate_limit") | said.contains("429"))
    kinds = F.when(limited, F.array(F.col("kind"), F.lit("rate_limit"))).otherwise(F.array("kind"))
    return rows.withColumn("kind", F.explode(kinds))


#: What is shown of a tool's input. `{a|b}` is the first of the fields that is there, or the text after a `?`; `[...]`
#: shows only if its field is there; `{a#}` is the length of a list, `{a~}` a text on one line, `{a!}` nothing, but its
#: brackets show only if the field is true. The texts are output.
SHOWN = {
    "Bash": "{command~}[ — {description}][ [bg]{run_in_background!}]",
    "Read": "{file_path?\\?}[ :{offset}][+{limit}]",
    "Edit": "{file_path?\\?}",
    "Write": "{file_path?\\?}",
    "Grep": "/{pattern}/[ in {path}][ --glob {glob}]",
    "Glob": "{pattern}[ in {path}]",
    "TodoWrite": "{todos#} todos",
    "WebFetch": "{url|query}",
    "WebSearch": "{url|query}",
    "Agent": "{subagent_type|name?\\?}: {description}",
    "Task": "{subagent_type|name?\\?}: {description}",
}


def _shown(template: str, given: str):
    """A template as a column. Optional parts are outermost brackets; a part without its field is null, then empty."""
    parts, depth, now = [], 0, ""
    for c in template:
        opens, closes = c == "[" and depth >= 0, c == "]"
        if opens and depth == 0 or closes and depth == 1:
            parts.append((depth, now))
            now = ""
        else:
            now += c
        depth += opens - closes
    parts.append((0, now))

    def filled(text: str, optional: int):
        out = []
        for k, piece in enumerate(re.split(r"\{(.*?)\}", text)):
            if k % 2 == 0:
                out.append(F.lit(piece))
                continue
            names, _, other = piece.partition("?")
            path = [f"$.{n.rstrip('#~!')}" for n in names.split("|")]
            if names.endswith("#"):
                value = F.coalesce(F.size(F.expr(f"try_cast(try_variant_get({given}, '{path[0]}', 'variant') as array<variant>)")), F.lit(0)).cast("string")
            elif names.endswith("!"):
                value = F.when(field(given, path[0], "boolean"), "")
            else:
                value = F.coalesce(*(field(given, p) for p in path))
                value = F.regexp_replace(value, r"\s+", " ") if names.endswith("~") else value
            out.append(value if optional else F.coalesce(value, F.lit(other.removeprefix("\\"))))
        return F.coalesce(F.concat(*out), F.lit(""))

    return F.concat(*(filled(text, optional) for optional, text in parts if text))


def preview(name, given: str):
    """One line that shows what a tool was given, by its template; other tools show their input's beginning. given is a
    variant column, name the tool's name."""
    out = F.substring(F.to_json(given), 1, 200)
    for template in dict.fromkeys(SHOWN.values()):
        out = F.when(name.isin([t for t, own in SHOWN.items() if own == template]), _shown(template, given)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def search(shown: DataFrame, kinds: list[str] | None = None, needle: str = "") -> DataFrame:
    """Rows of browse of the given kinds whose text holds the needle in any case."""
    out = shown.where(F.col("kind").isin(kinds)) if kinds else shown
    return out.where(F.contains(F.lower("text"), F.lit(needle.lower()))) if needle else out
