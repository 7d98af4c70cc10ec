"""Requests and replies of a stream of transcript lines, in whatever order lines arrive.

A batch merges the lines of a request and pairs replies with prompts by windows over a file. A stream keeps the lines of
each file that it still waits for as the file's state, and settles the file when the watermark says that it is complete.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmeter.functions import text
from quillmeter.operators import transcript

COUNTS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "eph5m", "eph1h", "text_chars")
_FIELDS = ("line_num", "pos", "kind", "us", "uuid", "request_id", "model", *COUNTS)
REQUESTS = "file_key string, line_num int, uuid string, request_id string, ts timestamp, model string, " + ", ".join(f"{c} long" for c in COUNTS) + ", reply_latency_s double"


def steps(ev: DataFrame, at: str = "at") -> DataFrame:
    """What the state needs of events (transcript.events with a column at, the time at which a line came): usable lines,
    prompts and interruptions, in short."""
    shown = F.aggregate(transcript._texts(), F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    used = ev.where("usable").withColumn("_calls", transcript._calls()).withColumns({k: c for k, c in transcript.usage_columns().items() if k in COUNTS} | {"text_chars": shown})
    used = used.select("file_key", F.col(at).alias("at"), "line_num", F.lit(-1).alias("pos"), F.lit("usage").alias("kind"), F.unix_micros("ts").alias("us"), "uuid", "request_id", "model", *COUNTS)
    said = ev.where("type = 'user'").select("file_key", F.col(at).alias("at"), "line_num", F.posexplode_outer(transcript._texts()).alias("pos", "t"), F.unix_micros("ts").alias("us"), "uuid")
    said = said.withColumns({"kind": text.prompt_kind(F.col("t")), "pos": F.coalesce("pos", F.lit(0))}).drop("t")
    # Every text tells that its line's id is known, also one that is no prompt.
    return used.unionByName(said, allowMissingColumns=True).select("file_key", "at", *_FIELDS)


def settled(rows: Iterable[list]) -> list[dict]:
    """The requests of a file's steps, whatever their order: lines of one request merged, counts by their maximum and the
    rest from the first line; each reply with its wait since the last prompt that is dated, no replay, and not taken up."""
    first: dict[str, int] = {}
    rows = sorted((dict(zip(_FIELDS, r, strict=True)) for r in rows), key=lambda r: (r["line_num"], r["pos"]))
    found: dict[str, dict] = {}
    anchor = None
    for r in rows:
        if r["kind"] == "usage":
            wait = None if anchor is None or r["us"] is None or r["us"] < anchor else (r["us"] - anchor) / 1e6
            anchor = None
            name = "=" + r["request_id"] if r["request_id"] else f"#{r['line_num']}"
            one = found.setdefault(name, {**r, "reply_latency_s": wait})
            for c in COUNTS:
                one[c] = max(one[c], r[c])
        elif r["uuid"] is None or first.setdefault(r["uuid"], r["line_num"]) == r["line_num"]:
            if r["kind"] == "interrupt":
                anchor = None
            elif r["kind"] == "prompt" and r["us"] is not None:
                anchor = r["us"]
    return list(found.values())


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        rows = settled(json.loads(state.get[0]))
        state.remove()
        if rows:
            out = pd.DataFrame(rows)
            out["file_key"], out["ts"] = key[0], pd.to_datetime(out["us"], unit="us")
            out["model"] = out["model"].replace("", "(unknown)")
            yield out[[c.split(" ")[0] for c in REQUESTS.split(", ")]]
        return
    held, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
    for frame in frames:
        last = max(last, int(frame["at"].max().timestamp() * 1000))
        plain = frame[list(_FIELDS)].astype(object).where(frame[list(_FIELDS)].notna(), None)
        held += [[int(v) if isinstance(v, float) else v for v in row] for row in plain.to_numpy().tolist()]
    state.update((json.dumps(held), last))
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))


def requests(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of REQUESTS from a stream of steps.

    A file is settled when the watermark, late behind the newest arrival, passes its last line, and its state goes; until
    then its lines may come in any order and batch. Lines that come after that are dropped by Spark, and counted: see
    LateRows. The state of a file is its lines in short, so it is bounded by the longest transcript that is still growing.
    """
    by_file = rows.withWatermark("at", late).groupBy("file_key")
    return by_file.applyInPandasWithState(_step, REQUESTS, "held string, last long", "append", GroupStateTimeout.EventTimeTimeout)


class LateRows(StreamingQueryListener):
    """Counts the rows of all queries that came after the watermark and were dropped."""

    def __init__(self):
        self.dropped = 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
