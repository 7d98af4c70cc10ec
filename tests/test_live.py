"""Requests of a stream in shuffled batches against those of a batch."""

from __future__ import annotations

import json
import random
import time
from datetime import UTC, datetime, timedelta

from quillmeter.operators import transcript
from quillmeter.streaming import live

START = datetime(2026, 1, 1, tzinfo=UTC)


def lines(rng):
    """Prompts, interruptions, replays, undated lines, and replies over several lines of one request."""
    out = []
    for f in range(6):
        for n in range(1, 30):
            at = (START + timedelta(seconds=60 * n + rng.randrange(90))).isoformat() if rng.random() < 0.9 else "2026"
            if rng.random() < 0.5:
                said = rng.choice(["hello", "[Request interrupted by user]", "<bash-input>x", [{"type": "text", "text": "a"}, {"type": "text", "text": rng.choice(["b", "[Request interrupted by user]"])}]])
                line = {"type": "user", "uuid": f"u{rng.randrange(12)}", "timestamp": at, "message": {"content": said}}
            else:
                usage = {"input_tokens": rng.randrange(99), "output_tokens": rng.randrange(99), "cache_creation": {"ephemeral_5m_input_tokens": rng.randrange(9)}}
                line = {"type": "assistant", "uuid": f"a{n}", "requestId": rng.choice(["", f"r{n // 4}"]), "timestamp": at, "message": {"model": rng.choice(["m", ""]), "content": "x" * rng.randrange(9), "usage": usage}}
            out.append((f"p/s/f{f}", n, json.dumps(line)))
    return out


def test_shuffled_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = lines(rng)
    kind = "file_key string, line_num int, value string"
    want = {(r["file_key"], r["line_num"]): r for r in transcript.records(transcript.events(spark.createDataFrame(rows, kind))).collect()}
    rng.shuffle(rows)
    for k in range(5):  # three batches of lines in any order; two that move the watermark; a line that comes too late
        part = rows[k::3] if k < 3 else [(f"z/z/end{k}", 1, rows[0][2])]
        arrived = START + timedelta(minutes=k) if k < 3 else START + timedelta(days=k)
        spark.createDataFrame([(*r, arrived) for r in part], kind + ", at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([("p/s/f0", 99, rows[0][2], START)], kind + ", at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/5")
    late = live.LateRows()
    spark.streams.addListener(late)
    stream = spark.readStream.schema(kind + ", at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    ev = transcript.events(stream, keep=["at"])
    got = []
    query = live.requests(live.steps(ev), "10 minutes").writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    query.awaitTermination(300)
    for _ in range(50):  # the listener is told later
        if late.dropped:
            break
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert query.exception() is None and late.dropped == 1
    got = [r for r in got if not r["file_key"].startswith("z/")]
    mine = {(r["file_key"], r["line_num"]): r for r in got}
    assert len(got) == len(mine) and set(mine) == set(want)
    for key, r in want.items():
        one = mine[key]
        wait = None if r["reply_latency_s"] is None else float(r["reply_latency_s"])
        assert (one["uuid"], one["request_id"], one["ts"], one["model"], one["input_tokens"], one["output_tokens"], one["eph5m"], one["text_chars"]) == (r["uuid"], r["request_id"], r["ts"], r["model"], r["fresh_tokens"], r["output_tokens"], r["eph5_tokens"], r["text_chars"])
        assert (one["reply_latency_s"] is None) == (wait is None) and (wait is None or abs(one["reply_latency_s"] - wait) < 0.001)

