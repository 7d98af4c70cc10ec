"""Transcripts written from the driver's conversations as JSON lines, and the parser's frames of them.

A conversation is a file. Ids and turns modulo small numbers decide on the shape of a line: content as text or as blocks,
repeated ids, broken times, limit errors, synthetic models, usage over several calls, tool calls and their results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmeter.functions import churn, text
from quillmeter.operators import transcript
from quillmeter.plans import timeline
from quillmeter.registry import query, r, sec
from quillmeter.sources import tables

BASE = 1_767_225_600


def lines(t) -> DataFrame:
    """(file_key, line_num, value): one line for each turn."""
    c, k, said = F.col("conv_id"), F.col("turn"), F.col("text")
    stamp = F.when((7 * c + k) % 13 == 0, "2026").otherwise(F.date_format(F.timestamp_seconds(BASE + 3600 * c + 60 * k), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    name = lambda prefix, n: F.concat_ws("-", F.lit(prefix), c, n)
    asked = F.when((c + k) % 11 == 0, "[Request interrupted by user]").when((c + k) % 7 == 0, "<bash-input>ls").otherwise(said)
    block = lambda **f: F.struct(*(v.alias(n) for n, v in f.items()))
    results = F.to_json(F.array(block(type=F.lit("tool_result"), tool_use_id=name("t", k - 1), content=F.lit("ok"), is_error=(c % 2 == 0))))
    own = F.to_json(F.array(block(type=F.lit("text"), text=asked)))
    content = F.when(k % 4 == 0, F.concat(F.substring(own, 1, F.length(own) - 1), F.lit(","), F.substring(results, 2, F.length(results)))).otherwise(F.to_json(F.array(asked)))
    content = F.when(k % 4 == 0, content).otherwise(F.substring(content, 2, F.length(content) - 2))
    user = F.concat(F.lit('{"type":"user","uuid":"'), name("u", F.when(((c + k) % 5 == 0) & (k >= 2), k - 2).otherwise(k)), F.lit('","timestamp":"'), stamp, F.lit('","message":{"role":"user","content":'), content, F.lit("}}"))
    size = F.length(said).cast("long")
    usage = block(
        input_tokens=size, output_tokens=10 * k + c % 10, cache_creation_input_tokens=c % 100, cache_read_input_tokens=2 * size,
        server_tool_use=F.when(c % 2 == 1, block(web_search_requests=k, web_fetch_requests=F.lit(1))),
        cache_creation=F.when(c % 3 == 0, block(ephemeral_5m_input_tokens=F.lit(0), ephemeral_1h_input_tokens=c % 50)),
        iterations=F.when(c % 4 == 1, F.array(block(input_tokens=size, output_tokens=F.lit(1), cache_read_input_tokens=k, server_tool_use=F.when(k % 2 == 1, block(web_search_requests=k + 1))), block(input_tokens=size + 3, output_tokens=F.lit(2), cache_read_input_tokens=F.lit(5), server_tool_use=F.when(k % 3 == 1, block(web_search_requests=F.lit(10).cast("int")))))))
    tool = F.element_at(F.array(*map(F.lit, ("Edit", "Write", "Bash"))), (k % 3 + 1).cast("int"))
    given = block(old_string=F.when(tool == "Edit", F.lit("a\nb")), new_string=F.when(tool == "Edit", said), content=F.when(tool == "Write", said), command=F.when(tool == "Bash", F.concat(F.lit("cat > f <<'E'\n"), said, F.lit("\nE\n"))))
    calls = F.to_json(F.array(block(type=F.lit("text"), text=said, id=F.lit(None).cast("string"), name=F.lit(None).cast("string"), input=F.lit(None).cast(_GIVEN)), block(type=F.lit("tool_use"), text=F.lit(None).cast("string"), id=name("t", k), name=tool, input=given)))
    limit = F.to_json(F.array(block(type=F.lit("text"), text=F.concat(F.lit("You are OUT of extra usage "), c))))
    model = F.when(c % 10 == 9, "<synthetic>").otherwise(F.element_at(F.array(*map(F.lit, ("claude-opus-4-7", "anthropic/claude-sonnet-4.5", "", "claude-haiku-9"))), (c % 4 + 1).cast("int")))
    limited = (c + k) % 17 == 0
    reply = F.concat(
        F.lit('{"type":"assistant","uuid":"'), name("a", k), F.lit('","requestId":"'), F.when(c % 6 == 5, "").otherwise(name("q", F.floor(k / 4))), F.lit('","timestamp":"'), stamp, F.lit('",'),
        F.when(limited, '"isApiErrorMessage":true,"error":"rate_limit",').otherwise(""), F.lit('"message":{"role":"assistant","model":"'), model, F.lit('","content":'), F.when(limited, limit).otherwise(calls), F.lit(',"usage":'), F.to_json(usage), F.lit("}}"))
    other = F.when(c % 3 == 0, "{bad").when(c % 3 == 1, "[1, 2]").otherwise('{"type":"system","content":"note"}')
    rows, place = t("conversations"), (file(), (k + 1).cast("int").alias("line_num"))
    shapes = (("role = 'user'", user), ("role = 'assistant'", reply), ("role not in ('user', 'assistant')", other))
    return reduce(DataFrame.union, (rows.where(only).select(*place, value.alias("value")) for only, value in shapes))


_GIVEN = "struct<old_string:string,new_string:string,content:string,command:string>"


def file() -> Column:
    return F.concat(F.lit("p"), F.col("conv_id") % 5, F.lit("/c"), F.col("conv_id"), F.lit("/c"), F.col("conv_id"), F.lit(".jsonl")).alias("file_key")


def events(t) -> DataFrame:
    """The parsed lines, written before and after parsing: as in an update, where lines come from objects, the parser's
    expressions stand alone and are compiled, and frames of events parse nothing again."""
    return tables.written(transcript.events(tables.written(lines(t), "lines")), "events")


#: The lines in SQL, with what the shape of each follows from.
LINES = f"""with l as (select 'p' || conv_id % 5 || '/c' || conv_id || '/c' || conv_id || '.jsonl' as file_key, conv_id as c, turn as k, turn + 1 as line_num, role, text, length(text) as size,
      case when (7 * conv_id + turn) % 13 <> 0 then to_timestamp({BASE} + 3600 * conv_id + 60 * turn) end as ts, (conv_id + turn) % 17 = 0 as limited,
      case when conv_id % 10 = 9 then '<synthetic>' else ['claude-opus-4-7', 'anthropic/claude-sonnet-4.5', '', 'claude-haiku-9'][conv_id % 4 + 1] end as model, ['Edit', 'Write', 'Bash'][turn % 3 + 1] as tool,
      case when (conv_id + turn) % 11 = 0 then 'interrupt' when (conv_id + turn) % 7 = 0 then 'tool' when trim(text, E' \\t\\n\\r\\f\\x0b') = '' then 'blank' else 'prompt' end as kind,
      case when (conv_id + turn) % 5 = 0 and turn >= 2 then turn - 2 else turn end as uid from conversations),
    users as (select *, min(line_num) over (partition by c, uid) < line_num as replay from l where role = 'user'),
    usable as (select *, case when c % 6 = 5 then '#' || line_num else '=' || k // 4 end as request, case when c % 4 = 1 then 2 * size + 3 else size end as i, case when c % 4 = 1 then 3 else 10 * k + c % 10 end as o, case when c % 4 = 1 then 0 else c % 100 end as made,
      case when c % 4 = 1 then k + 5 else 2 * size end as seen, case when c % 3 = 0 then c % 50 else 0 end as hour, case when c % 4 = 1 then greatest(size + k, size + 8) end as peak from l where role = 'assistant' and not limited and model <> '<synthetic>'),
    marks as (select c, line_num, 1 as mark, case when kind = 'prompt' then ts end as anchor, null::timestamptz as ts from users where not replay and (kind = 'interrupt' or kind = 'prompt' and ts is not null)),
    steps as (select *, lag(anchor) over (partition by c order by line_num) as before from (select * from marks union all select c, line_num, 0, null, ts from usable)),
    waits as (select c, line_num, case when ts >= before then (epoch_us(ts) - epoch_us(before)) / 1e6 end as wait from steps where mark = 0),
    recs as (select u.file_key, u.c, min(u.line_num) as line_num, arg_min(struct_pack(u := 'a-' || u.c || '-' || k, t := ts, m := case when model = '' then '(unknown)' else model end, w := wait), u.line_num) as one, max(i)::bigint as i, max(o)::bigint as o, max(made)::bigint as made, max(seen)::bigint as seen, max(hour)::bigint as hour, max(size)::bigint as chars, arg_min(peak, u.line_num) as peak
      from usable u join waits w on w.c = u.c and w.line_num = u.line_num group by u.file_key, u.c, request),
    records as (select file_key, c, line_num, one.u as uuid, one.t as ts, one.m as model, one.w as wait, i, o, made, seen, hour, chars, coalesce(peak, i + made + seen) as ctx from recs),
    asked as (select file_key, c, line_num from users where kind = 'prompt')"""
_RATE = "case c % 4 when 0 then {0} when 1 then {1} when 2 then {0} else {2} end / 1e6"
_COST = " + ".join(f"{n} * " + _RATE.format(*p) for n, p in (("i", (5.0, 3.0, 1.0)), ("greatest(0, made - hour)", (6.25, 3.75, 1.25)), ("hour", (10.0, 6.0, 2.0)), ("seen", (0.5, 0.3, 0.1)), ("o", (25.0, 15.0, 5.0))))


@query(f"""{LINES} select file_key, line_num, uuid, coalesce(epoch_us(ts) // 1000000, -1) as at_s, model, i as fresh_tokens, o as output_tokens, made as cache_creation_tokens, seen as cache_read_tokens, 0 as eph5_tokens, hour as eph1h_tokens, chars as text_chars, ctx as ctx_input, round(wait, 3) as wait, round(round({_COST}, 6), 4) as cost, c % 4 in (2, 3) as estimated from records""")
def transcript_requests(t):
    """Requests: lines merged by id with their largest counts, calls summed, writes by duration, sizes, contexts, prices."""
    out = transcript.records(events(t))
    counts = [F.col(c).cast("long").alias(c) for c in ("fresh_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "eph5_tokens", "eph1h_tokens", "text_chars", "ctx_input")]
    return out.select("file_key", F.col("line_num").cast("long").alias("line_num"), "uuid", F.coalesce(sec("ts"), F.lit(-1)).alias("at_s"), "model", *counts, r("reply_latency_s", 3).alias("wait"), r("cost_usd").alias("cost"), "estimated")


@query(f"""{LINES}, x as (select file_key, request, line_num, c % 4 = 1 and (k % 2 = 1 or k % 3 = 1) as listed, case when c % 4 = 1 and (k % 2 = 1 or k % 3 = 1) then case when k % 2 = 1 then k + 1 else 0 end + case when k % 3 = 1 then 10 else 0 end when c % 2 = 1 then k end as searches, case when c % 2 = 1 and not (c % 4 = 1 and (k % 2 = 1 or k % 3 = 1)) then 1 end as fetches from usable)
    select file_key, min(line_num) as line_num, coalesce(max(searches), -1)::bigint as searches, coalesce(max(fetches), -1)::bigint as fetches from x group by file_key, request""")
def transcript_server_tools(t):
    """What requests let the server look up: summed by name over a line's calls, the largest of a request's lines."""
    out = transcript.records(events(t))
    of = lambda name: F.coalesce(F.try_element_at("server_tool_use", F.lit(name)), F.lit(-1))
    return out.select("file_key", F.col("line_num").cast("long").alias("line_num"), of("web_search_requests").alias("searches"), of("web_fetch_requests").alias("fetches"))


@query(f"{LINES} select file_key, count(*) as n, sum(line_num)::bigint as lines from asked group by 1")
def transcript_prompts(t):
    """Prompts by file; interruptions and what tools write are none."""
    return transcript.prompts(events(t)).groupBy("file_key").agg(F.count("*").alias("n"), F.sum("line_num").alias("lines"))


@query(f"{LINES} select file_key, u.line_num, round(wait, 3) as wait from usable u join waits w on w.c = u.c and w.line_num = u.line_num")
def reply_pairs(t):
    """Waits of replies for the last dated prompt that no reply or interruption took up; replays change nothing."""
    return transcript.latencies(events(t)).select("file_key", F.col("line_num").cast("long").alias("line_num"), r("reply_latency_s", 3).alias("wait"))


_CHURN = "(length(text) - length(replace(text, E'\\n', '')) + case when text = '' or text like E'%\\n' then 0 else 1 end)"


@query(rf"""{LINES}, done as (select c, k - 1 as k, c % 2 = 0 as failed from l where role = 'user' and k % 4 = 0), x as (select u.*, failed from usable u left join done d on d.c = u.c and d.k = u.k)
    select file_key, line_num, tool as tool_name, case when failed then 1 when failed is null then -1 else 0 end::bigint as is_error, case when coalesce(failed, false) then 0 when tool = 'Bash' then case when text = '' then 0 else length(text) - length(replace(text, E'\n', '')) + 1 end else {_CHURN} end::bigint as lines_added, case when coalesce(failed, false) or tool <> 'Edit' then 0 else 2 end::bigint as lines_deleted from x""")
def transcript_tool_calls(t):
    """Tool calls with their last result and the lines they changed; failed ones change none."""
    return transcript.tool_uses(events(t)).select("file_key", F.col("line_num").cast("long").alias("line_num"), "tool_name", F.coalesce(F.col("is_error").cast("long"), F.lit(-1)).alias("is_error"), "lines_added", "lines_deleted")


@query(f"{LINES}, done as (select c, k - 1 as k, line_num from l where role = 'user' and k % 4 = 0) select l.file_key, l.line_num as call_line, coalesce(d.line_num, -1) as result_line from l left join done d on d.c = l.c and d.k = l.k where role = 'assistant' and not limited")
def transcript_call_results(t):
    """Calls with the line of their result."""
    return timeline.calls_with_results(events(t)).select("file_key", F.col("call_line").cast("long").alias("call_line"), F.coalesce("result_line", F.lit(-1)).cast("long").alias("result_line"))


@query(f"{LINES} select file_key, line_num as line, 'You are OUT of extra usage ' || c as content from l where role = 'assistant' and limited")
def transcript_limit_hits(t):
    """Replies that say that the extra usage is out."""
    return transcript.limit_hits(events(t)).select("file_key", F.col("line").cast("long").alias("line"), "content")


_TURNS = f"""{LINES}, both_ as (select c, line_num, 1 as asks, 0 as rank, null::timestamptz as ts, null::bigint as ctx, null::bigint as o, null as file_key from asked union all select c, line_num, 0, 1, ts, ctx, o, file_key from records),
    n as (select *, sum(asks) over (partition by c order by line_num, rank) as seen_asks from both_), d as (select *, max(seen_asks) over (partition by c order by ts is not null, ts, line_num rows unbounded preceding) as turn from n where rank = 1),
    x as (select file_key, c, turn, arg_max(struct_pack(line := line_num, input := ctx, output := o), struct_pack(a := ts is not null, b := ts, c := line_num)) as z from d group by 1, 2, 3),
    turns as (select file_key, row_number() over w as idx, z.line as line, z.input as input, z.output as output, z.input - coalesce(lag(z.input) over w, 0) as delta from x where z.input > 0 window w as (partition by c order by turn))"""


@query(f"{_TURNS} select file_key, idx, line, input, output, delta from turns")
def turn_boundaries(t):
    """Context turns: the last request before each prompt, and how the context grew."""
    ev = events(t)
    out = transcript.context_turns(transcript.records(ev), transcript.prompts(ev))
    return out.select("file_key", *(F.col(c).cast("long").alias(c) for c in ("idx", "line", "input", "output", "delta")))


@query(f"{_TURNS}, f as (select 'p' || conv_id % 5 || '/c' || conv_id || '/c' || conv_id || '.jsonl' as file_key from (select distinct conv_id from conversations)) select f.file_key, coalesce(a.n, 0) as prompt_count, coalesce(b.n, 0) as turn_count, coalesce(b.last, -1) as last, coalesce(h.n, 0) as hits from f left join (select file_key, count(*) as n from asked group by 1) a using (file_key) left join (select file_key, count(*) as n, arg_max(input, idx) as last from turns group by 1) b using (file_key) left join (select file_key, count(*) as n from l where role = 'assistant' and limited group by 1) h using (file_key)")
def transcript_files(t):
    """One row for each transcript, with its counts, turns and hits."""
    ev = events(t)
    recs, asked = transcript.records(ev), transcript.prompts(ev)
    listing = t("conversations").select(file()).distinct()
    out = transcript.files(listing, asked, transcript.context_turns(recs, asked), transcript.limit_hits(ev))
    last = F.try_element_at("ctx_turns", F.lit(-1))["input"].cast("long")
    return out.select("file_key", F.col("prompt_count").cast("long").alias("prompt_count"), F.col("turn_count").cast("long").alias("turn_count"), F.coalesce(last, F.lit(-1)).alias("last"), F.size("rate_limit_hits").cast("long").alias("hits"))


_SHOWN = f"""{LINES}, shown as (select file_key, line_num, case when role = 'user' then case when k % 4 = 0 then 'user' else 'user' end when role = 'assistant' then 'assistant' when c % 3 = 0 then 'parse_error' when c % 3 = 1 then 'parse_error' else 'system' end as kind from l
    union all select file_key, line_num, 'tool_result' from l where role = 'user' and k % 4 = 0 union all select file_key, line_num, 'tool_use' from l where role = 'assistant' and not limited)"""


@query(f"{_SHOWN} select file_key, kind, count(*) as n, sum(line_num)::bigint as lines from shown group by 1, 2")
def transcript_browse(t):
    """Lines as a reader sees them: a row for each block, and lines that are no JSON objects."""
    return transcript.browse(tables.written(lines(t), "lines")).groupBy("file_key", "kind").agg(F.count("*").alias("n"), F.sum("line_num").alias("lines"))


@query(f"{LINES} select file_key, line_num from l where role = 'assistant' and not limited and contains(lower(text), 'the') ")
def transcript_search(t):
    """Replies that hold a word in any case."""
    return transcript.search(transcript.browse(tables.written(lines(t), "lines")), ["assistant"], "THE").select("file_key", F.col("line_num").cast("long").alias("line_num"))


@query(f"""{_SHOWN}, s as (select file_key, string_agg(kind || '=' || n, ',' order by kind) as kinds from (select file_key, kind, count(*) as n from shown group by 1, 2) group by 1), u as (select file_key, string_agg(tool || '=' || n, ',' order by tool) as tools from (select file_key, tool, count(*) as n from l where role = 'assistant' and not limited group by 1, 2) group by 1),
    q as (select file_key, sum(i)::bigint as input, sum(o)::bigint as output, round(100.0 * sum(seen) / sum(i + made + seen), 4) as hit_rate from records group by 1) select file_key, kinds, tools, coalesce(input, -1) as input, coalesce(output, -1) as output, case when input is not null then hit_rate else 0.0 end as hit_rate from s left join u using (file_key) left join q using (file_key)""")
def transcript_stats(t):
    """By file: rows by kind, calls by tool, tokens and hit rate."""
    src = tables.written(lines(t), "lines")
    out = timeline.session_stats(transcript.browse(src), transcript.records(transcript.events(src)))
    text_of = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("file_key", text_of("kinds").alias("kinds"), text_of("tools").alias("tools"), F.coalesce("fresh_tokens", F.lit(-1)).alias("input"), F.coalesce("output_tokens", F.lit(-1)).alias("output"), r("hit_rate").alias("hit_rate"))


@query(r"select conv_id, turn, case when turn % 3 = 0 then length(text) - length(replace(text, E'\n', '')) + case when text = '' or text like E'%\n' then 0 else 1 end when turn % 3 = 1 then 0 else case when text = '' then 0 else length(text) - length(replace(text, E'\n', '')) + 1 end end::bigint as added, case when turn % 3 = 0 then 1 else 0 end::bigint as deleted from conversations where role = 'assistant'")
def shell_and_edit_churn(t):
    """Lines of edits, of commands that write files, and of those that don't."""
    said, k = F.col("text"), F.col("turn") % 3
    command = F.when(k == 1, F.concat(F.lit("cat <<'E' | sort\n"), said, F.lit("\nE\n"))).when(k == 2, F.concat(F.lit("cd x && cat >> 'a b' <<'E'\n"), said, F.lit("\nE\nls > out\n")))
    added, deleted = churn.edit_churn(F.when(k == 0, "Edit").otherwise("Bash"), F.lit("one"), said, F.lit(None).cast("string"))
    rows = t("conversations").where("role = 'assistant'").withColumn("shell", churn.shell_churn(command))
    return rows.select("conv_id", "turn", (added + F.col("shell.added")).cast("long").alias("added"), (deleted + F.col("shell.deleted")).cast("long").alias("deleted"))


@query("select o_orderkey, case when o_orderkey % 7 = 0 then 0 else o_orderkey % 4 end::bigint as added, case when o_orderkey % 7 = 0 then 0 else o_orderkey % 3 end::bigint as deleted from orders")
def patch_churn(t):
    """Lines of patches that commands are given; the names of files and what only shows a patch don't count."""
    k = F.col("o_orderkey")
    lines = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    run = F.when(k % 7 == 0, "cat").when(k % 2 == 0, "patch -p1").otherwise("git apply --index")
    command = F.concat(run, F.lit(" <<'D'\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n same\n"), lines("-old line\n", k % 3), lines("+new line\n", k % 4), F.lit("D\n"))
    rows = t("orders").select("o_orderkey", churn.shell_churn(command).alias("c"))
    return rows.select("o_orderkey", F.col("c.added").cast("long").alias("added"), F.col("c.deleted").cast("long").alias("deleted"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 0 else o_orderkey % 4 + 1 end::bigint as added, case when o_orderkey % 5 in (0, 1) then 0 else o_orderkey % 3 + 1 end::bigint as deleted from orders")
def script_churn(t):
    """Lines that scripts put in place of others, or write; scripts that only print change none."""
    k = F.col("o_orderkey")
    literal = lambda text, n: F.concat(F.lit("'"), F.repeat(F.lit(text), n.cast("int")), F.lit("'\n"))
    ends = F.when(k % 5 == 0, "print(s.replace(old, new))").when(k % 5 == 1, "p.write_text(new)").otherwise("p.write_text(s.replace(old, new))")
    command = F.concat(F.lit("python3 - <<'P'\nold = "), literal("a\\n", k % 3 + 1), F.lit("new = "), literal("b\\n", k % 4 + 1), ends, F.lit("\nP\n"))
    rows = t("orders").select("o_orderkey", churn.shell_churn(command).alias("c"))
    return rows.select("o_orderkey", F.col("c.added").cast("long").alias("added"), F.col("c.deleted").cast("long").alias("deleted"))


@query("""with x as (select event_id, (case event_id % 4 when 0 then 1 when 1 then 1000 when 2 then 1000000 else 1000000000 end) * floor(value * 10) / 10.0 * (case when event_id % 7 = 0 then -1 else 1 end) as v from events),
    s as (select *, case when abs(v) >= 1e9 then 9 when abs(v) >= 1e6 then 6 when abs(v) >= 1e3 then 3 else 0 end as e from x), d as (select *, cast(floor(abs(v) / 10 ** e * 10 + 0.5) as bigint) as tenths, cast(floor(abs(v) + 0.5) as bigint) as whole from s)
    select event_id, case when v < 0 and (whole > 0 or e > 0) then '-' else '' end || case when e = 0 then whole::varchar else (tenths // 10)::varchar || '.' || (tenths % 10)::varchar || case e when 9 then 'B' when 6 then 'M' else 'K' end end as shown from d""")
def human_numbers(t):
    """Numbers as a reader sees them, digit by digit."""
    i = F.col("event_id")
    v = F.when(i % 4 == 0, 1).when(i % 4 == 1, 1000).when(i % 4 == 2, 1000000).otherwise(1000000000) * F.floor(F.col("value") * 10) / 10.0 * F.when(i % 7 == 0, -1).otherwise(1)
    return t("events").select("event_id", F.regexp_replace(text.human_number(v), "^-0$", "0").alias("shown"))


_NOTE = "o_orderkey % 5"


@query(f"""with k as (select o_orderkey as n, ['system', 'queue-operation', 'attachment', 'permission-mode', 'user'][{_NOTE} + 1] as kind, o_orderpriority as p from orders)
    select n as line_num, kind, case when kind = 'system' and n % 2 = 0 then 'rate_limit' else p end as name, case when kind in ('system', 'queue-operation') then 'c' || n else '' end as content from k where kind <> 'user'
    union all select n, 'rate_limit', 'rate_limit', 'c' || n from k where kind = 'system' and n % 2 = 0
    union all select n, 'rate_limit', p, 'c' || n from k where kind = 'system' and n % 2 = 1 and contains('c' || n, '429')""")
def transcript_notes(t):
    """Lines beside the talk, with what names them."""
    n, p = F.col("o_orderkey"), F.col("o_orderpriority")
    kind = F.element_at(F.array(*map(F.lit, ("system", "queue-operation", "attachment", "permission-mode", "user"))), (n % 5 + 1).cast("int"))
    only = lambda k, c: F.when(kind == k, c)
    value = F.to_json(F.struct(
        kind.alias("type"), F.when(n % 5 < 2, F.concat(F.lit("c"), n)).alias("content"), only("system", F.when(n % 2 == 0, "rate_limit").otherwise(p)).alias("subtype"), only("queue-operation", p).alias("operation"),
        only("attachment", F.struct(p.alias("type"))).alias("attachment"), only("permission-mode", p).alias("permissionMode")))
    src = t("orders").select(F.lit("f").alias("file_key"), n.alias("line_num"), value.alias("value"))
    return transcript.notes(src).select("line_num", "kind", "name", "content")


@query("""with k as (select l_orderkey as o, l_linenumber as l, ['Bash', 'Read', 'Edit', 'Grep', 'Glob', 'WebFetch', 'Task', 'Other'][(l_orderkey + l_linenumber) % 8 + 1] as tool, l_returnflag as f, l_orderkey % 2 = 0 as more from lineitem)
    select o, l::bigint as l, case tool when 'Bash' then 'run ' || f || case when more then ' — why [bg]' else '' end when 'Read' then 'p' || f || case when more then ' :' || l || '+9' else '' end when 'Edit' then 'p' || f when 'Grep' then '/' || f || '/' || case when more then ' in src --glob *.py' else '' end
      when 'Glob' then f || case when more then ' in src' else '' end when 'WebFetch' then 'http://' || f when 'Task' then 'kind' || f || ': ' || case when more then 'why' else '' end else '{"x":"' || f || '"}' end as shown from k""")
def tool_previews(t):
    """What each tool was given, in one line."""
    at, line, flag = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")
    tool = F.element_at(F.array(*map(F.lit, ("Bash", "Read", "Edit", "Grep", "Glob", "WebFetch", "Task", "Other"))), ((at + line) % 8 + 1).cast("int"))
    given = lambda *tools, value, more=False: F.when(tool.isin(*tools) & ((at % 2 == 0) if more else F.lit(True)), value)
    fields = {
        "command": given("Bash", value=F.concat(F.lit("run \n "), flag)), "description": given("Bash", "Task", value=F.lit("why"), more=True), "run_in_background": given("Bash", value=F.lit(True), more=True), "file_path": given("Read", "Edit", value=F.concat(F.lit("p"), flag)),
        "offset": given("Read", value=line, more=True), "limit": given("Read", value=F.lit(9), more=True), "pattern": given("Grep", "Glob", value=flag), "path": given("Grep", "Glob", value=F.lit("src"), more=True), "glob": given("Grep", value=F.lit("*.py"), more=True),
        "url": given("WebFetch", value=F.concat(F.lit("http://"), flag)), "subagent_type": given("Task", value=F.concat(F.lit("kind"), flag)), "x": given("Other", value=flag)}
    rows = t("lineitem").select(at.alias("o"), line.cast("long").alias("l"), tool.alias("tool"), F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("j"))
    rows = rows.withColumn("given", F.expr("parse_json(j)"))
    return rows.select("o", "l", transcript.preview(F.col("tool"), "given").alias("shown"))


@query("select c_custkey, 't' || c_custkey as task_id, case when c_custkey % 2 = 0 then 'u' || c_nationkey else '' end as tool_use_id, '' as output_file, 'done' as event, case when c_custkey % 3 = 0 then 'tool-results/r' || c_custkey || '.txt' else '' end as stored from customer where c_custkey % 5 > 0")
def task_notifications(t):
    """Notifications of tasks and stored results that a text mentions."""
    k = F.col("c_custkey")
    told = F.concat(F.lit("see <task-notification><task-id>t"), k, F.lit("</task-id>"), F.when(k % 2 == 0, F.concat(F.lit("<tool-use-id>u"), F.col("c_nationkey"), F.lit("</tool-use-id>"))).otherwise(""), F.lit("\n<event>done</event></task-notification>"))
    said = F.concat(F.when(k % 5 > 0, told).otherwise("nothing"), F.when(k % 3 == 0, F.concat(F.lit(" in tool-results/r"), k, F.lit(".txt"))).otherwise(" in my-tool-results/x.txt"))
    rows = t("customer").select("c_custkey", F.explode(text.notifications(said)).alias("n"), F.array_join(text.references(said), ",").alias("stored"))
    return rows.select("c_custkey", "n.*", "stored")
