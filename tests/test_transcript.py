"""Transcript parsing on small hand-written files."""

from __future__ import annotations

import json
import lzma
import os
from datetime import UTC, datetime
from decimal import Decimal

import pytest

from quillmeter.functions.churn import command_churn
from quillmeter.operators import rollups, series, transcript
from quillmeter.operators.dedup import canonical
from quillmeter.plans import panels
from quillmeter.sources import tables, transcripts
from quillmeter.streaming import ingest

MODEL = "claude-sonnet-4-5"


def user(text, ts="2026-01-01T00:00:00Z", **more):
    return {"type": "user", "timestamp": ts, "message": {"role": "user", "content": text}, **more}


def reply(ts="2026-01-01T00:00:01Z", rid="", model=MODEL, content="", usage=None, **more):
    return {"type": "assistant", "timestamp": ts, "requestId": rid, "message": {"role": "assistant", "model": model, "content": content, "usage": usage if usage is not None else {"input_tokens": 100, "output_tokens": 200}}, **more}


def events(spark, files):
    rows = [(k, i, x if isinstance(x, str) else json.dumps(x)) for k, lines in files.items() for i, x in enumerate(lines, 1)]
    return transcript.events(spark.createDataFrame(rows, "file_key string, line_num int, value string")).cache()


def test_requests(spark):
    many = {"iterations": [{"input_tokens": 10, "output_tokens": 1, "cache_read_input_tokens": 5}, {"input_tokens": 20, "output_tokens": 2, "cache_creation_input_tokens": 7, "cache_creation": {"ephemeral_1h_input_tokens": 7}}], "input_tokens": 1}
    ev = events(spark, {
        "one": [user("hi"), reply()],
        "stream": [reply(rid="r", usage={"input_tokens": 100, "output_tokens": 1}, uuid="u1"), reply(ts="2026-01-01T00:00:09Z", rid="r", usage={"input_tokens": 100, "output_tokens": 200}, content=[{"type": "text", "text": "héllo"}], uuid="u2")],
        "unsplit": [reply(usage={"cache_creation_input_tokens": 1_000_000})],
        "split": [reply(usage={"cache_creation_input_tokens": 2_000_000, "cache_creation": {"ephemeral_5m_input_tokens": 1_000_000, "ephemeral_1h_input_tokens": 1_000_000}})],
        "calls": [reply(usage=many)],
        "left out": ["[1, 2]", "3", "{bad", "", '{"type":"system"}', reply(model="<synthetic>"), reply(usage={}), reply(usage={"input_tokens": 1}, isApiErrorMessage=True, error="rate_limit")],
        "twice": ['{"type":"assistant","requestId":"x","message":{"usage":{"input_tokens":1,"input_tokens":5}}}'],
    })
    got = {r["file_key"]: r for r in transcript.records(ev).collect()}
    assert set(got) == {"one", "stream", "unsplit", "split", "calls", "twice"}
    assert (got["one"]["fresh_tokens"], got["one"]["output_tokens"], got["one"]["cost_usd"], got["one"]["reply_latency_s"]) == (100, 200, Decimal("0.003300"), Decimal("1.000"))
    assert (got["stream"]["line_num"], got["stream"]["output_tokens"], got["stream"]["text_chars"], got["stream"]["uuid"]) == (1, 200, 5, "u1")
    assert (got["unsplit"]["cost_usd"], got["split"]["cost_usd"]) == (Decimal("3.750000"), Decimal("9.750000"))
    assert [got["calls"][c] for c in ("fresh_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "eph1h_tokens", "ctx_input")] == [30, 3, 5, 7, 7, 27]
    assert (got["twice"]["fresh_tokens"], got["twice"]["model"], got["twice"]["estimated"]) == (5, "(unknown)", True)


def test_latency_prompts_and_hits(spark):
    at = lambda s: f"2026-01-01T00:00:{s:02d}Z"
    ev = events(spark, {
        "list": [user([{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], at(0)), reply(at(10)), reply(at(12))],
        "stop": [user("x", at(0)), user([{"type": "text", "text": "[Request interrupted by user]"}], at(1)), reply(at(5))],
        "replay": [user("x", at(0), uuid="u"), reply(at(5)), user("x", at(0), uuid="u"), reply(at(9))],
        "undated": [user("x", at(1)), user("y", "2026"), reply(at(4)), user("<bash-input>ls"), user("   ")],
        "back": [user("x", at(9)), reply(at(5))],
        "limit": [user("x", at(0)), {"type": "assistant", "timestamp": "nonsense", "isApiErrorMessage": True, "error": "rate_limit", "message": {"content": [{"type": "text", "text": "You're Out of extra usage"}]}}, reply(at(3))],
    })
    got = {}
    for r in transcript.latencies(ev).orderBy("file_key", "line_num").collect():
        got.setdefault(r["file_key"], []).append(r["reply_latency_s"] and float(r["reply_latency_s"]))
    assert got == {"list": [10.0, None], "stop": [None], "replay": [5.0, None], "undated": [3.0], "back": [None], "limit": [3.0]}
    assert {r["file_key"]: r["count"] for r in transcript.prompts(ev).groupBy("file_key").count().collect()} == {"list": 2, "stop": 1, "replay": 2, "undated": 2, "back": 1, "limit": 1}
    assert [tuple(r) for r in transcript.limit_hits(ev).collect()] == [("limit", 2, "nonsense", "You're Out of extra usage")]


def test_tool_calls(spark):
    call = lambda i, name, **inp: {"type": "tool_use", "id": i, "name": name, "input": inp}
    result = lambda i, **more: {"type": "tool_result", "tool_use_id": i, "content": "", **more}
    ev = events(spark, {"f": [
        reply(rid="r", content=[call("a", "Edit", old_string="1\n2", new_string="1\n2\n3\n4")]), reply(rid="r", content=[call("b", "Write", content="x\ny\nz\n"), call("a", "Edit")]),
        user([result("a"), result("b", is_error=True)]), reply(rid="s", content=[call("c", "Bash", command="cat > f <<'E'\n1\n2\n3\nE\n"), call("", "Read")]), user([result("c", is_error=True)]), user([result("c", is_error=False)]),
    ]})
    uses = transcript.tool_uses(ev)
    got = [(r["tool_name"], r["line_num"], r["is_error"], r["lines_added"], r["lines_deleted"]) for r in uses.orderBy("line_num", "idx").collect()]
    assert got == [("Edit", 1, False, 4, 2), ("Write", 2, True, 0, 0), ("Bash", 4, False, 3, 0), ("Read", 4, None, 0, 0)]
    recs = transcript.records(ev)
    assert rollups.with_model(uses, recs).where("model is null").count() == 0
    assert rollups.with_model(uses, recs, by_request=False).where("model is null").count() == 1


def brute_turns(recs, asked):
    bounds, order, out, last, i = sorted(asked), sorted(recs, key=lambda r: (r[1] is not None, r[1] or 0, r[0])), [], None, 0
    for r in order:
        while i < len(bounds) and bounds[i] <= r[0]:
            if last:
                out.append(last)
            last, i = None, i + 1
        last = r
    return [r[0] for r in out + [last] if r and r[2] > 0]


@pytest.mark.parametrize("seed", range(4))
def test_context_turns(spark, seed):
    import random

    rng = random.Random(seed)
    lines = list(range(1, 30))
    asked = rng.sample(lines, 6)
    recs = [(n, rng.choice([None, rng.randrange(1000)]), rng.choice([0, 5, 9])) for n in lines if n not in asked]
    rows = [("f", n, t and datetime.fromtimestamp(t, UTC), c, 1) for n, t, c in recs]
    got = transcript.context_turns(spark.createDataFrame(rows, "file_key string, line_num int, ts timestamp, ctx_input long, output_tokens long"), spark.createDataFrame([("f", n) for n in asked], "file_key string, line_num int"))
    assert [r["line"] for r in got.orderBy("idx").collect()] == brute_turns([(n, t or None, c) for n, t, c in recs], asked)


@pytest.mark.parametrize(
    "command, want",
    [
        ("cat >> notes <<EOF\na\nb\nc\nEOF\n", (3, 0)), ("cat <<'E' > out\nx\ny\nE", (2, 0)), ("cat > f <<-'E'\n\ta\n\tE\n", (1, 0)), ("cat > f <<'E'\nE\n", (0, 0)), ("tee -a f <<'E'\n1\nE", (1, 0)),
        ("git commit -F - <<'E'\nfix\nE\n", (0, 0)), ("cat > /dev/null <<E\na\nE", (0, 0)), ("pytest > out.txt", (0, 0)), ("", (0, 0)), ("x" * 1_000_001, (0, 0)),
        ("patch -p1 <<'D'\n--- a\n+++ b\n-a\n+b\nD\n", (1, 1)), ("cat > a <<'A' > b <<'B'\n1\nA\n2\n3\nB\n", (3, 0)),
        ("python3 - <<'P'\ns = open('f').read()\nprint(s.replace('a', 'b'))\nP\n", (0, 0)), ("python3 - <<'P'\nold = 'a\\nb\\n'\nnew = 'x\\n'\np.write_text(s.replace(old, new))\nP\n", (1, 2)),
        ("python3 - <<'P'\nnew = 'a'\nnew = new + y\np.write_text(s.replace('old', new))\nP\n", (0, 0)), ("python3 -c 'p.write_text(s.replace(\"a\", \"b\\nc\"))'", (2, 1)), ("python3 - <<'P'\ndef (:\nP\n", (0, 0)),
        ("python - <<'P'\nimport re\nopen('f', 'w').write(re.sub('x', 'y\\nz', t))\nP\n", (2, 1)), ("python - <<'P'\nsys.stdout.write('a')\nP\n", (0, 0)),
        # Several commands, pipelines, substitutions, quotes and comments.
        ("cat > a <<'A'\n1\n2\nA\ncat >> b <<B\n3\nB\n", (3, 0)), ("cd x && cat >f <<E; echo done > log\na\nE\nls", (1, 0)), ("cat <<E | tee f\na\nb\nE\n", (2, 0)), ("sudo tee f >/dev/null <<E\na\nE\n", (1, 0)),
        ("git commit -m \"$(cat <<'E'\nsubject\n\nbody\nE\n)\"\n", (0, 0)), ("psql db <<'Q'\nselect 1;\nQ\n", (0, 0)), ("node - <<'J'\nfs.write('a')\nJ\n", (0, 0)), ("cat <<E 2> err\na\nE\n", (0, 0)), ("cat <<E >&2\na\nE\n", (0, 0)),
        ("echo \"cat > f <<E\"\n", (0, 0)), ("# don't: cat > f <<E\ncat > g <<E\na\nE\n", (1, 0)), ("cat > 'a b' <<\"E F\"\n1\nE F\n", (1, 0)), ("cat > f <<E\nit's\nE\ncat > g <<E\n\"x\nE\n", (2, 0)), ("x=$((1<<2)); cat > f <<E\na\nE\n", (1, 0)),
        ("cat <<< word > f", (0, 0)), ("git apply --index <<'P'\n+a\nP\n", (1, 0)), ("cat > f <<E\nnever ends", (1, 0)), ("python3 -c \"p.write_text('a\\nb')\" && ls", (2, 0)), ("python3 -c 'open", (0, 0)), ("cat > f <<E\n\nE\n", (0, 0)),
        ("python3.12 - <<'P'\np.write_text('a')\nP\n", (1, 0)), ("pythonx - <<'P'\np.write_text('a')\nP\n", (0, 0)), ("cat file | python3 - <<'P'\nfor new in ('a', 'b'):\n    s = s.replace('old', new)\np.write_text(s)\nP\n", (0, 0)),
        ("echo $(cat > f <<E\na\nE\n) > g", (1, 0)), ("(cat > f <<E\na\nE\n)", (1, 0)), ("cat > f <<E && cat > g <<F\n1\nE\n2\nF\n", (2, 0)),
    ],
)
def test_shell_churn(command, want):
    assert command_churn(command) == want


@pytest.fixture
def mirror(tmp_path):
    def put(key, lines):
        path = tmp_path / "in" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        raw = "\n".join(json.dumps(x) for x in lines).encode()
        path.write_bytes(lzma.compress(raw) if key.endswith(".xz") else raw)
        return path

    put("projA/s1/s1.jsonl", [user("a", "2026-01-15T10:30:00Z"), reply("2026-01-15T10:30:02Z", "r1", uuid="shared"), reply("2026-01-15T11:40:00Z", "r2", "claude-opus-4-7", uuid="own")])
    put("projA/s1/agent-aa.jsonl.xz", [reply("2026-01-15T10:30:02Z", "r1", uuid="shared")])
    put("projB/s2/s2.jsonl", [user("b", "2026-07-15T10:30:00Z"), reply("2026-07-15T10:30:09Z", "r3", content=[{"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "ls"}}]), user([{"type": "tool_result", "tool_use_id": "t", "is_error": True}])])
    put("projB/s2/notes.txt", [])
    put("short.jsonl", [])
    return tmp_path, put


def test_updates_and_panels(spark, mirror):
    root, put = mirror
    source, out = str(root / "in"), str(root / "out")
    (root / "in/projA/s1/bad.jsonl.xz").write_bytes(b"no xz")
    made = ingest.update(spark, source, out)
    t = ingest.load(spark, out)
    assert (t.files.count(), t.records.count(), t.records.where("is_canonical").count()) == (3, 4, 3)
    assert made.read("damaged").count() == 1
    now = datetime(2026, 8, 1, tzinfo=UTC)
    year, live = panels.View.of("365d", now), panels.View(datetime(2025, 8, 1, tzinfo=UTC), 900)
    total = lambda df, c: df.agg({c: "sum"}).first()[0]
    hourly = panels.hourly(t, year)
    assert total(hourly, "requests") == total(panels.activity_heatmap(t, year), "requests") == total(panels.hourly(t, live), "requests") == 3
    grid = {(r["dow"], r["hour"]) for r in panels.activity_heatmap(t, live).collect()}
    assert {(4, 11), (3, 12)} <= grid  # the zone's winter and summer time
    costs = panels.cache_per_model(t, year)
    assert float(total(t.records.where("is_canonical"), "cost_usd")) == pytest.approx(total(costs, "cost"))
    assert float(total(panels.cost_by_model(t, year), "cost")) == pytest.approx(float(total(panels.cost_by_project(t, year), "cost")))
    for v in (year, live):
        assert [(r["tool"], r["n_total"], r["n_error"]) for r in panels.tool_error_rate(t, v).collect()] == [("Bash", 1, 1)]
        assert total(panels.tool_usage(t, v), "n") == 1
        assert total(panels.reply_latency(t, v), "n") == 2
        assert panels.response_sizes(t, v).count() == 0
        assert panels.counters(t, v).first()["total_sessions"] == 2
        assert {r["session_id"]: r["model"] for r in panels.sessions(t, v).collect()} == {"s1": MODEL, "s2": MODEL}
    assert [r["session_id"] for r in panels.session_list(t, limit=1).collect()] == ["s2", "s1"]
    assert panels.session_detail(t, "s1").first()["fresh_tokens"] == 200
    assert panels.top_requests(t, year, "output_tokens").count() == 3 and panels.top_requests(t, year, "cache_read_tokens").count() == 0
    assert panels.token_breakdown(t, year).count() == 5 and panels.models(t).count() == 2 and panels.projects(t, year).count() == 2
    assert panels.ctx_traces(t, panels.View(datetime(2020, 1, 1, tzinfo=UTC), 900)).count() == 3
    assert panels.context_growth(t, panels.View(datetime(2020, 1, 1, tzinfo=UTC), 900)).count() == 2
    assert panels.session_context(t, "s1").first()["total"] == 1
    assert panels.rate_limit_hits(t, year).count() == 0
    assert panels.cache_total(costs).first()["requests"] == 3 and panels.latency_outliers(panels.reply_latency(t, year)).count() == 0

    # Nothing to do, a changed object, a vanished one.
    told, before = [], sorted(str(p) for p in (root / "out").rglob("*"))
    assert ingest.update(spark, source, out, tell=told.append).parts == made.parts and told == []
    assert sorted(str(p) for p in (root / "out").rglob("*")) == before and not (root / "out/_work").exists()
    put("projB/s2/s2.jsonl", [reply("2026-07-15T10:30:09Z", "r3"), reply("2026-07-15T10:31:09Z", "r4"), reply("2026-07-15T10:32:09Z", "r5")])
    (root / "in/projA/s1/agent-aa.jsonl.xz").unlink()
    later = ingest.update(spark, source, out, tell=told.append)
    assert told == [{"event": "ingest_done", "version": "2", "parsed": 1, "vanished": 1}]
    assert (later.read("files").count(), later.read("records").count(), later.read("tool_uses").count()) == (2, 5, 0)


    # Stored by day; one update at a time; old versions go; a lock of a process that died is taken over.
    plan = later.read("records").where("day = date'2026-07-15'").select("file_key")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    with tables.only_one(spark, out), pytest.raises(RuntimeError):
        ingest.update(spark, source, out)
    put("projB/s3/s3.jsonl", [reply("2026-07-16T10:30:09Z", "r9")])
    (root / "out/_lock").touch()
    os.utime(root / "out/_lock", (0, 0))
    last = ingest.update(spark, source, out, keep=1)
    assert last.number == 3 and [p.name for p in (root / "out/_manifest").iterdir()] == ["v=3"] and not (root / "out/_lock").exists()
    assert {str(p) for p in (root / "out/records").glob("v=*/day=*")} == {p.removeprefix("file:") for p in last.parts["records"].values()}


def test_attempts(spark, mirror, monkeypatch):
    root, _ = mirror
    calls, whole = [], ingest._update
    monkeypatch.setattr(ingest, "_update", lambda *a: calls.append(1) or (whole(*a) if len(calls) > 1 else 1 / 0))
    assert "files" in ingest.update(spark, str(root / "in"), str(root / "out")).parts
    calls.clear()
    monkeypatch.setattr(ingest, "_update", lambda *a: calls.append(1) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.update(spark, str(root / "in"), str(root / "out"))
    assert len(calls) == ingest.ATTEMPTS


def test_mailbox():
    hub = ingest.Hub()
    box, other = hub.listen(2), hub.listen()
    for i in range(20):
        hub.tell({"n": i})
    assert box.take() == [{"n": 0}, {"n": 1}] and box.take() == [] and box.dropped == 18
    hub.leave(box)
    hub.tell({"n": 20})
    assert box.take() == [] and len(other.take()) == 16


def test_follow(spark, mirror):
    root, _ = mirror
    told = []
    listener = ingest.Notifier(told.append)
    spark.streams.addListener(listener)
    q = ingest.follow(spark, str(root / "in"), str(root / "out"), str(root / "check"))
    q.awaitTermination(120)
    spark.streams.removeListener(listener)
    assert q.exception() is None and ingest.load(spark, str(root / "out")).files.count() == 3


def test_sources(spark, mirror):
    root, _ = mirror
    with pytest.raises(ValueError):
        transcripts.inside("/x", "../y")
    one = transcripts.one_object(spark, str(root / "in"), "projA/s1/agent-aa.jsonl")
    assert one.first()["text"].startswith("{") and one.first()["file_key"] == "projA/s1/agent-aa.jsonl.xz" and "projB" not in str(one.inputFiles())
    assert transcripts.one_object(spark, str(root / "in"), "projA/none.jsonl").count() == 0
    own = spark.createDataFrame([("projB/s2/s2.jsonl", "etag of the store")], "key string, etag string")
    found = {r["key"]: r["etag"] for r in transcripts.objects(spark, str(root / "in"), etags=own).select("key", "etag").collect()}
    assert found["projB/s2/s2.jsonl"] == "etag of the store" and len(found["projA/s1/s1.jsonl"]) == 40
    made = transcripts.made_up(spark, 3, 4)
    assert made.count() == 24 and transcript.records(transcript.events(made)).count() == 12
    shown = transcript.browse(made)
    assert transcript.search(shown, ["user"], "PROMPT 2").count() == 3
    assert tables.without_orphans(made, made.limit(0)).count() == 24


def test_canonical_and_ema(spark):
    rows = spark.createDataFrame([("a", 1, "u"), ("b", 1, "u"), ("a", 2, None), ("b", 2, None)], "file_key string, line_num int, uuid string")
    assert {(r[0], r[1]): r[3] for r in canonical(rows).select("file_key", "line_num", "uuid", "is_canonical").collect()} == {("a", 1): True, ("b", 1): False, ("a", 2): True, ("b", 2): True}
    values = [((i * 37) % 101) / 7 for i in range(300)]
    want = [values[0]]
    for v in values[1:]:
        want.append(0.3 * v + 0.7 * want[-1])
    got = series.ema(spark.createDataFrame(list(enumerate(values)), "i int, v double"), [], ["i"], "v", 0.3).orderBy("i").collect()
    assert [r["ema"] for r in got] == pytest.approx(want)
