"""Means, kept rows and percentiles of long series against plain loops, in many small parts and rounds."""

from __future__ import annotations

import math
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.operators import quantiles, scans, series

START = datetime(2026, 1, 1, tzinfo=UTC)


def test_means_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None, ""]), i, rng.choice([None, rng.random() * 100]), -rng.random()) for i in range(3000)] + [("z", 0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double, w double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for by, alpha in ((["k"], 0.15), ([], 0.9), (["k"], F.when(F.col("k") == "b", 0.5).otherwise(0.02))):
            got = {r["i"] if r["k"] != "z" else "z": (r["e"], r["f"]) for r in series.emas(df, by, ["i"], {"e": "v", "f": "w"}, alpha).collect()}
            last = {}
            for k, i, v, w in sorted(rows, key=lambda r: r[1] if r[0] != "z" else (-1 if not by else 0)):
                if not by and k == "z":
                    continue
                a = alpha if isinstance(alpha, float) else 0.5 if k == "b" else 0.02
                now = (v or 0.0, w)
                before = last.get(k if by else "")
                last[k if by else ""] = now if before is None else tuple(a * x + (1 - a) * y for x, y in zip(now, before, strict=True))
                if by:
                    assert got[i if k != "z" else "z"] == pytest.approx(last[k])
            if not by:
                ordered = sorted(rows, key=lambda r: r[1])
                assert len(got) == len(ordered)
        assert series.ema(df.limit(0), ["k"], ["i"], "v").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def greedy(times, gap):
    out = []
    for t in sorted(times):
        if not out or t > out[-1] + gap:
            out.append(t)
    return out


@pytest.mark.parametrize("long", [10, 10**6])
def test_kept_apart(spark, monkeypatch, long):
    """Groups walked in order and groups by pointer doubling keep the same."""
    monkeypatch.setattr(scans, "LONG", long)
    rng = random.Random(5)
    rows = [(k, START + timedelta(seconds=rng.choice([0, 60, 61, 3600, rng.randrange(n)])), rng.randrange(3)) for k, n in (("dense", 2000), ("sparse", 90_000), (None, 500), ("few", 9)) for _ in range(3 if k == "few" else 90)] + [("few", None, 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, tie int").repartition(5)
    got = scans.kept_apart(df, ["k"], "ts", ["tie"], 60).collect()
    for key in {r[0] for r in rows}:
        own = [(t, x) for k, t, x in rows if k == key and t]
        want = [(t, min(x for u, x in own if u == t)) for t in greedy({t for t, _ in own}, timedelta(seconds=60))]
        assert sorted((r["ts"].replace(tzinfo=UTC), r["tie"]) for r in got if r["k"] == key) == want
    assert scans.kept_apart(df.limit(0), ["k"], "ts", ["tie"], 60).count() == 0
    alone = scans.kept_apart(df, [], "ts", ["tie"], 60).select("ts").collect()
    assert [r["ts"].replace(tzinfo=UTC) for r in sorted(alone)] == greedy({t for _, t, _ in rows if t}, timedelta(seconds=60))


def test_selection(spark, monkeypatch):
    for name, value in (("HOT", 20), ("SORTED", 5), ("CELLS", 4)):
        monkeypatch.setattr(quantiles, name, value)
    rng = random.Random(9)
    groups = {
        "even": [rng.random() for _ in range(500)], "same": [3.5] * 100, "heavy": [10.0 ** rng.randrange(-20, 20) for _ in range(300)], None: [float(rng.randrange(4)) for _ in range(200)],
        "wide": [-1.7e308, 1.7e308, *range(-50, 50)], "endless": [math.inf, -math.inf, *range(60)], "small": [1.0, 2.0, 9.0], "nothing": [None],
    }
    df = spark.createDataFrame([(k, v if v is None else float(v)) for k, vs in groups.items() for v in [*vs, None]], "k string, v double").repartition(4)
    points = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.937, "e": 1.0}
    for r in quantiles.nearest(df, ["k"], "v", points).collect():
        vs = sorted(groups[r["k"]])
        assert r["n"] == len(vs) and [r[p] for p in points] == [vs[min(len(vs) - 1, math.floor(len(vs) * q))] for q in points.values()]
    finite = df.where("k is null or k <> 'endless'")
    got = {r["k"]: r for r in quantiles.interpolated(finite, ["k"], "v", points).collect()}
    want = {r["k"]: r for r in finite.groupBy("k").agg(F.count("*").alias("n"), *(F.percentile("v", F.lit(q)).alias(p) for p, q in points.items())).collect()}
    assert got == want and len(got) == 7
    assert quantiles.interpolated(finite.limit(0), ["k"], "v", points).count() == 0


def test_prefix_composition():
    rng = np.random.default_rng(1)
    a, b = rng.random(37), rng.random((37, 2))
    x, want = np.zeros(2), []
    for i in range(37):
        x = a[i] * x + b[i]
        want.append(x)
    scans._composed(a, b)
    assert np.allclose(b, np.array(want))
