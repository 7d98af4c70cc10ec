"""Bucketed tables, dense numbers with bitmaps, and rates from a table."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quillmeter.functions import pricing
from quillmeter.operators import rollups, scans
from quillmeter.sources import tables

START = datetime(2026, 1, 20, tzinfo=UTC)


def test_buckets_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("f"), F.col("id") % 50).alias("file_key"), F.col("id").alias("line_num"), F.concat(F.lit("u"), F.col("id")).alias("uuid"), F.concat(F.lit("r"), F.col("id")).alias("request_id"), F.lit("m").alias("model"))
    calls = rows.select("file_key", "line_num", "request_id")
    try:
        one = tables.save_bucketed(rows, "records_b", f"{tmp_path}/r", buckets=8, blooms=("uuid", "request_id"))
        two = tables.save_bucketed(calls, "calls_b", f"{tmp_path}/c", buckets=8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        joined = rollups.with_model(two, one)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 600 and joined.where("model is null").count() == 0
        found = one.where("uuid = 'u77'")
        assert found.count() == 1 and "EqualTo(uuid,u77)" in found._jdf.queryExecution().executedPlan().toString()
        footer = b"".join(p.read_bytes() for p in (tmp_path / "r").glob("*.parquet"))
        plain = b"".join(p.read_bytes() for p in (tmp_path / "c").glob("*.parquet"))
        assert len(footer) > len(plain) + 8 * 100_000  # the filters
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for name in ("records_b", "calls_b"):
            spark.sql(f"drop table if exists {name}")


def test_numbers_and_bitmaps(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(300)}", f"p{rng.randrange(3)}", START + timedelta(hours=rng.randrange(60)), rng.choice("ab")) for _ in range(900)]
    usage = spark.createDataFrame(rows, "session_id string, project_id string, hour timestamp, model string").repartition(5)
    numbers = rollups.session_numbers(usage)
    names = sorted({r[0] for r in rows})
    assert {r["session_id"]: r["number"] for r in numbers.collect()} == {s: k for k, s in enumerate(names)}
    far = numbers.withColumn("number", F.col("number") * 1000)  # several bitmaps for a group
    for given in (numbers, far):
        maps = rollups.session_bitmaps(usage, given)
        assert {(r["project_id"], r["model"]): r["session_count"] for r in rollups.sessions_in(maps, ["project_id", "model"]).collect()} == {(p, m): len({s for s, q, _, n in rows if (q, n) == (p, m)}) for p in {r[1] for r in rows} for m in "ab"}
        assert rollups.sessions_in(maps.where(F.col("hour") < START + timedelta(hours=9)), [F.lit(1).alias("k")]).first()["session_count"] == len({s for s, _, h, _ in rows if h < START + timedelta(hours=9)})
    assert scans.numbered(usage.limit(0), ["session_id"]).count() == 0


def test_rates(spark):
    rng = random.Random(3)
    day = lambda n: START + timedelta(days=n)
    windows = [(k, key, rng.choice([None, day(rng.randrange(90))]), rng.choice([None, day(rng.randrange(90))])) for k, key in enumerate(["claude-opus-4-7"] * 25 + ["claude-sonnet-4-5"] * 6 + ["claude-haiku-4-5"])]
    windows += [(90, "claude-opus-4-8", None, None), (91, "claude-opus-4-8", None, day(20)), (92, "claude-sonnet-4-5", None, None)]
    rates = spark.createDataFrame([(k, key, a, b, *[float(k)] * 5) for k, key, a, b in windows], pricing.RATE_TABLE)
    models = ["claude-opus-4-7", "x/claude-opus-4.7-20260101", "claude-sonnet-4-5", "claude-haiku-4-5[1m]", "claude-opus-9", "gpt", "", None]
    rows = [(i, rng.choice(models), rng.choice([None, day(rng.randrange(100)), day(20)])) for i in range(400)]
    got = {r["i"]: r for r in pricing.with_rates(spark.createDataFrame(rows, "i int, model string, ts timestamp"), rates).collect()}
    for i, model, ts in rows:
        name = (model or "").lower().replace(".", "-")
        key = next((k for k in ("claude-opus-4-7", "claude-sonnet-4-5", "claude-haiku-4-5") if k in name), None)
        assert got[i]["estimated"] == (key is None)
        own = [w for w in windows if w[1] == (key or ("claude-opus-4-8" if "opus" in name else "claude-opus-4-7"))]
        held = [w for w in own if (w[2] is None and w[3] is None if not key or ts is None else (w[2] is None or w[2] <= ts) and (w[3] is None or ts < w[3]))]
        best = min(held, key=lambda w: (w[3] or datetime.max.replace(tzinfo=UTC), -(w[2] or datetime.min.replace(tzinfo=UTC)).timestamp(), w[0]), default=None)
        assert (got[i]["rates"] and got[i]["rates"]["fresh"]) == (best and float(best[0])), (i, model, ts, best)


def test_rates_of_crowded_months(spark):
    """Thousands of overlapping windows of one key: an hour's rows find their segments by sorting, at work that doesn't grow
    with rows times segments."""
    rng = random.Random(5)
    at = lambda m: START + timedelta(minutes=m)
    windows = [(k, "claude-opus-4-7", at(a), at(a + rng.choice([0, 1, 7, 300, 5000]))) for k, a in enumerate(rng.randrange(3000) for _ in range(400))]
    windows += [(500, "claude-sonnet-4-5", None, at(90)), (501, "claude-sonnet-4-5", at(2000), None), (502, "claude-opus-4-8", None, None), (503, "claude-sonnet-4-5", None, None)]
    rates = spark.createDataFrame([(k, key, a, b, *[float(k)] * 5) for k, key, a, b in windows], pricing.RATE_TABLE)
    rows = [(i, rng.choice(["claude-opus-4-7", "claude-sonnet-4-5", "claude-opus-9"]), rng.choice([None, *[at(rng.randrange(-100, 9000)) + timedelta(seconds=rng.choice([0, 0, 17]))] * 9])) for i in range(600)]
    priced = pricing.with_rates(spark.createDataFrame(rows, "i int, model string, ts timestamp"), rates)
    assert priced.columns == ["i", "model", "ts", "rate_key", "estimated", "rates"]
    got = {r["i"]: r["rates"] and r["rates"]["fresh"] for r in priced.collect()}
    assert len(got) == len(rows)
    far = datetime.max.replace(tzinfo=UTC), datetime.min.replace(tzinfo=UTC)
    for i, model, ts in rows:
        guessed = model == "claude-opus-9"
        own = [w for w in windows if w[1] == ("claude-opus-4-8" if guessed else model)]
        held = [w for w in own if (w[2] is None and w[3] is None if guessed or ts is None else (w[2] is None or w[2] <= ts) and (w[3] is None or ts < w[3]))]
        best = min(held, key=lambda w: (w[3] or far[0], -(w[2] or far[1]).timestamp(), w[0]), default=None)
        assert got[i] == (best and float(best[0])), (i, model, ts, best)


def test_rates_find_blocks(spark):
    """A window's numbers are cut into blocks that lie beside each other, two of a size at most."""
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(a + 1, 70, 2)] + [(3, 1 << 40)]
    for r in spark.createDataFrame(pairs, "a long, b long").withColumn("blocks", pricing._blocks("a", "b")).collect():
        spans = sorted((x["place"] << x["level"], (x["place"] + 1) << x["level"]) for x in r["blocks"])
        assert spans[0][0] == r["a"] and spans[-1][1] == r["b"] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and len(spans) <= 2 * (r["b"] - r["a"]).bit_length()
