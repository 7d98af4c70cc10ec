"""Updates at the cost of what changed, against everything computed anew."""

from __future__ import annotations

import os
import random
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillmeter.operators import rollups
from quillmeter.operators.dedup import canonical
from quillmeter.sources import tables, versions
from quillmeter.streaming import incremental

FILES = "file_key string, project_id string, session_id string, is_main boolean, last_modified timestamp, etag string, version string"
RECORDS = "file_key string, line_num int, uuid string, request_id string, ts timestamp, model string, fresh_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, eph5_tokens long, eph1h_tokens long, cost_usd decimal(12,6), reply_latency_s decimal(10,3)"
CALLS = "file_key string, line_num int, idx int, request_id string, ts timestamp, tool_name string, is_error boolean, lines_added long, lines_deleted long"
START = datetime(2026, 1, 1, tzinfo=UTC)


def made_file(rng, key, generation):
    """A file's rows: ids that other files share, on days of their own; some without time or id."""
    project, session, _ = key.split("/")
    at = lambda: None if rng.random() < 0.05 else START + timedelta(hours=rng.randrange(24 * 8), seconds=rng.randrange(3600))
    records, calls = [], []
    for line in range(1, rng.randrange(0, 12)):
        n = [rng.randrange(100) for _ in range(6)]
        uid = None if rng.random() < 0.2 else f"u{rng.randrange(60)}"
        records.append((key, line, uid, f"r{line}" if rng.random() < 0.8 else "", at(), rng.choice(["opus", "sonnet", "", "haiku"]), *n, Decimal(rng.randrange(10**6)) / 10**6, None if rng.random() < 0.3 else Decimal(rng.randrange(9000)) / 100))
    for line in range(1, rng.randrange(0, 8)):
        calls.append((key, line, rng.randrange(2), f"r{rng.randrange(9)}", at(), rng.choice(["Bash", "Edit"]), rng.choice([None, True, False]), rng.randrange(9), rng.randrange(9)))
    calls = list({(c[1], c[2]): c for c in calls}.values())
    return (key, project, session, rng.random() < 0.5, START + timedelta(minutes=rng.randrange(999)), f"e{generation}", "1"), records, calls


def frames(spark, state):
    return (
        spark.createDataFrame([f for f, _, _ in state], FILES),
        spark.createDataFrame([r for _, rows, _ in state for r in rows], RECORDS),
        spark.createDataFrame([c for _, _, rows in state for c in rows], CALLS),
    )


def content(df, columns=None):
    df = df.select(*(c for c in sorted(columns or df.columns) if c not in ("day", "bucket", "generation", "days")))
    return sorted(map(repr, df.collect()))


def test_updates_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "GENERATIONS", 2)
    rng, out = random.Random(0), str(tmp_path)
    state = {}
    for step, size in enumerate((25, 6, 3)):
        keys = [f"p{rng.randrange(3)}/s{rng.randrange(6)}/f{rng.randrange(25)}" for _ in range(size)]
        gone = [k for k in state if rng.random() < 0.15] if step else []
        change = {k: made_file(rng, k, step) for k in keys if k not in gone}
        old = versions.latest(spark, out)
        made = incremental.apply(old, *frames(spark, list(change.values())), spark.createDataFrame([(k,) for k in gone], "file_key string"), f"{out}/_work/{step}").commit()
        state = {k: v for k, v in state.items() if k not in gone} | change
        files, records, calls = frames(spark, list(state.values()))
        records = canonical(records)
        assert content(made.read("files")) == content(files)
        assert content(made.read("records")) == content(records)
        assert content(made.read("tool_uses")) == content(calls)
        for name, want in (("usage", rollups.usage(records, files)), ("tools", rollups.tools(calls, records, files)), ("latency", rollups.latency(records, files))):
            assert content(made.read(name), want.columns) == content(want), (step, name)
        claims = made.read("claims").join(made.read("files").select("file_key", "generation"), ["file_key", "generation"], "left_semi")
        assert content(claims, ["uuid", "file_key", "line_num"]) == content(records.where("uuid is not null"), ["uuid", "file_key", "line_num"])
        assert len(made.parts["claims"]) <= 3
        versions.prune(spark, out, 2)
        assert content(versions.latest(spark, out).read("records")) == content(records)


def many(spark, files, changed=()):
    """Tables of many files, a day for ten of them; the changed ones have other counts."""
    rows = spark.range(files).select(F.col("id").alias("f"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line_num"))
    key = F.concat(F.lit("p"), F.col("f") % 7, F.lit("/s"), F.col("f"), F.lit("/s"), F.col("f"))
    rows = rows.where(F.col("f").isin(list(changed))) if changed else rows
    more = 1 if changed else 0
    rows = rows.withColumns({"file_key": key, "ts": F.timestamp_seconds(1_767_225_600 + F.floor(F.col("f") / 10) * 86400 + F.col("line_num") * 600)})
    names = [f.split(" ")[0] for f in RECORDS.split(", ")]
    given = {"uuid": F.concat(F.lit("u"), F.col("f"), F.lit("-"), F.col("line_num")), "request_id": F.lit("r"), "model": F.lit("opus"), "cost_usd": F.lit(Decimal("0.5")).cast("decimal(12,6)"), "reply_latency_s": F.lit(2).cast("decimal(10,3)")}
    records = rows.select(*(given.get(c, F.col(c) if c in rows.columns else F.lit(5 + more).cast("long")).alias(c) for c in names)).withColumn("line_num", F.col("line_num").cast("int"))
    held = rows.select("file_key").distinct().select("file_key", F.split("file_key", "/")[0].alias("project_id"), F.split("file_key", "/")[1].alias("session_id"), F.lit(True).alias("is_main"), F.lit(START).cast("timestamp").alias("last_modified"), F.lit(f"e{more}").alias("etag"), F.lit("1").alias("version"))
    return held, records, spark.createDataFrame([], CALLS)


def test_written_follows_what_changed(spark, tmp_path):
    """One of 2000 files: its day, its bucket and its claims are written, a hundredth of the whole."""
    out = str(tmp_path)
    none = spark.createDataFrame([], "file_key string")
    first = incremental.apply(versions.latest(spark, out), *many(spark, 2000), none, f"{out}/_work/1")
    first.commit()
    second = incremental.apply(versions.latest(spark, out), *many(spark, 2000, [777]), none, f"{out}/_work/2")
    made = second.commit()
    size = lambda paths: sum(os.path.getsize(os.path.join(d, f)) for p in paths for d, _, fs in os.walk(p) for f in fs if f.endswith(".parquet"))
    assert [p for p in second.written if "/records/" in p] == [f"{out}/records/v=2/day=2026-03-19"]
    assert len([p for p in second.written if "/usage/" in p or "/latency/" in p]) == 2 and len([p for p in second.written if "/files/" in p]) == 1
    assert size(p for p in second.written if "/projects/" not in p) < 0.06 * size(first.written)
    assert made.parts["records"]["2026-03-18"].endswith("v=1/day=2026-03-18")
    assert made.read("usage").agg(F.sum("fresh_tokens")).first()[0] == 5 * 3 * 2000 + 3
    plan = made.read("records").where("day = date'2026-03-19'").select("file_key")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert versions.latest(spark, out).read("records", ["2026-03-19"]).count() == 30
    with pytest.raises(Exception):  # noqa: B017  # the number is taken
        second.commit()


def test_removing_everything(spark, tmp_path):
    out = str(tmp_path)
    held, records, calls = many(spark, 20)
    incremental.apply(versions.latest(spark, out), held, records, calls, held.select("file_key").limit(0), f"{out}/_work/1").commit()
    made = incremental.apply(versions.latest(spark, out), held.limit(0), records.limit(0), calls, held.select("file_key"), f"{out}/_work/2").commit()
    assert [made.read(k).count() for k in ("files", "records", "tool_uses", "usage", "tools", "latency")] == [0] * 6
    assert made.read("projects").count() == 7


def test_lock(spark, tmp_path):
    out = str(tmp_path)
    with tables.only_one(spark, out, beat_s=0.1) as owned:
        with pytest.raises(RuntimeError), tables.only_one(spark, out):
            pass
        os.utime(f"{out}/_lock", (0, 0))
        import time

        time.sleep(0.6)  # the holder lives, so its lock is fresh again
        with pytest.raises(RuntimeError), tables.only_one(spark, out):
            pass
        owned()
        (tmp_path / "_lock").write_text("other")
        with pytest.raises(RuntimeError):
            owned()
    assert (tmp_path / "_lock").read_text() == "other"  # not ours to delete
