"""Bringing stored tables up to date: in batches by etag, or as a stream of new files.

A batch parses the objects that are new or changed, replaces their rows, drops those of vanished objects and brings what
is derived up to date: duplicates, usage, tool calls, latencies. The order in which objects arrive makes no difference.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quillmeter.operators import transcript
from quillmeter.plans.panels import Tables
from quillmeter.sources import stores, tables, transcripts, versions
from quillmeter.streaming import incremental

#: Stored with each file; another version means that every file is parsed again.
VERSION = "1"
#: Versions of tables that stay, and attempts at an update.
KEEP, ATTEMPTS = 3, 2


@dataclass(frozen=True)
class Parsed:
    files: DataFrame
    records: DataFrame
    tool_uses: DataFrame
    damaged: DataFrame


def to_do(listing: DataFrame, stored: DataFrame | None, version: str = VERSION) -> DataFrame:
    """Listed transcripts that aren't stored (or known as damaged) with this etag and version."""
    found = listing.withColumn("version", F.lit(version))
    return found if stored is None else found.join(stored.select("file_key", "etag", "version"), ["file_key", "etag", "version"], "left_anti")


def parse(listing: DataFrame, work: str | None = None, store=None) -> Parsed:
    """The frames of listed transcripts. A damaged object is reported and doesn't stop the others. With a work folder the
    events are written there once, and all frames read them; without one each frame parses the lines anew. With a store
    (and a work folder) objects are streamed line by line, with attempts for each."""
    if store:
        stores.stream_objects(listing, store).write.mode("overwrite").parquet(f"{work}/lines")
        found = listing.sparkSession.read.parquet(f"{work}/lines")
        damaged = found.where("error is not null").select("file_key", "error")
        lines = found.where("error is null").join(damaged, "file_key", "left_anti").drop("error")
    else:
        lines, damaged = transcripts.read_lines(listing)
    ev = transcript.events(lines)
    if work:
        ev.write.mode("overwrite").parquet(f"{work}/events")
        damaged.write.mode("overwrite").parquet(f"{work}/damaged")
        ev, damaged = (listing.sparkSession.read.parquet(f"{work}/{k}") for k in ("events", "damaged"))
    recs, asked = transcript.records(ev), transcript.prompts(ev)
    files = transcript.files(listing.drop("content"), asked, transcript.context_turns(recs, asked), transcript.limit_hits(ev))
    good = files.join(damaged.select("file_key"), "file_key", "left_anti")
    return Parsed(good, recs, transcript.tool_uses(ev), damaged)


def update(
    spark: SparkSession, root: str, out: str, version: str = VERSION, tell: Callable[[dict], None] | None = None, keep: int = KEEP, attempts: int = ATTEMPTS, etags: DataFrame | None = None, streamed: bool = False
) -> versions.Version:
    """Parses what changed below root and makes a new version of the tables below out; returns it.

    Only the parts that a change touches are written (see incremental.apply); without new, changed or vanished objects
    nothing is. Readers keep the version they have: parts are written beside the old ones, and the manifest last; keep
    versions stay, older ones go. A second update of one out at the same time is refused (RuntimeError). tell is called
    after the update. A step that fails is tried again, attempts times in all. etags (key, etag) are the store's own; with
    streamed objects are listed by the store itself, and read line by line with attempts of their own.
    """
    with tables.only_one(spark, out) as owned:
        for attempt in range(1, attempts + 1):
            try:
                made, changed = _update(spark, root, out, version, keep, etags, streamed, owned)
                break
            except AnalysisException:  # no attempt makes a missing column or table appear
                raise
            except Exception:
                if attempt == attempts:
                    raise
    if tell and changed:
        tell({"event": "ingest_done", "version": str(made.number), **changed})
    return made


def _update(spark: SparkSession, root: str, out: str, version: str, keep: int, etags: DataFrame | None, streamed: bool, owned: Callable[[], None]) -> tuple[versions.Version, dict[str, int]]:
    listing = transcripts.transcripts(stores.listing(spark, root) if streamed else transcripts.objects(spark, root, etags=etags))
    old = versions.latest(spark, out)
    seen = [old.read(k).select("file_key", "etag", "version") for k in ("files", "damaged") if k in old]
    new = to_do(listing, reduce(DataFrame.union, seen) if seen else None, version)
    kept = listing.select("file_key")
    parsed = new.count()
    listed = kept.limit(1).count() > 0  # an empty listing is more likely a failed one, and removes nothing
    gone = old.read("files").select("file_key").join(kept, "file_key", "left_anti") if old.number and listed else spark.createDataFrame([], "file_key string")
    vanished = gone.count()
    if old.number and not parsed and not vanished:
        return old, {}
    work = f"{out}/_work/{old.number + 1}"
    found = parse(new, work, stores.store_of(root) if streamed else None)
    damaged = found.damaged.join(new.select("file_key", "etag", "version"), "file_key")
    if "damaged" in old:  # those that didn't change since aren't read again
        damaged = tables.without_orphans(tables.replaced(old.read("damaged"), damaged, new), kept)
    change = incremental.apply(old, found.files, found.records, found.tool_uses, gone, work, lambda c: c.put("damaged", damaged))
    owned()
    made = change.commit()
    tables.delete(spark, f"{out}/_work")
    versions.prune(spark, out, keep)
    return made, {"parsed": parsed, "vanished": vanished}


def load(spark: SparkSession, out: str) -> Tables:
    """The stored tables of the latest version, for panels."""
    v = versions.latest(spark, out)
    return Tables(*(v.read(k).drop("bucket", "generation", "days") if k in ("files", "records", "tool_uses") else v.read(k).drop("day") for k in ("files", "records", "tool_uses", "usage", "tools", "latency")))


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A stream that runs an update when new objects appear below root: once for what is there, or again and again.

    A file stream sees new paths only; changed objects are found by their etag in the update that any new one sets off.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root).select("path")
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda _batch, _number: update(spark, root, out) and None)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def live_buckets(stream: DataFrame, ts: str, by: list[str], sums: dict, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Totals by time window of a stream, complete once the watermark has passed; rows that come later are lost to it,
    unlike in a batch."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def live_sessions(stream: DataFrame, ts: str, by: list[str], sums: dict, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by gap of a stream, each given out when the watermark has passed its end."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


class Mailbox:
    """A bounded queue for a slow listener: what comes while it is full is dropped, and nothing waits."""

    def __init__(self, most: int = 16):
        self.waiting: deque[dict] = deque()
        self.most, self.dropped = most, 0

    def put(self, message: dict) -> None:
        if len(self.waiting) < self.most:
            self.waiting.append(message)
        else:
            self.dropped += 1

    def take(self) -> list[dict]:
        """All messages so far, oldest first."""
        return [self.waiting.popleft() for _ in range(len(self.waiting))]


class Hub:
    """Hands each message to the mailboxes of all who listen: update(tell=hub.tell), Notifier(hub.tell)."""

    def __init__(self):
        self.boxes: list[Mailbox] = []

    def listen(self, most: int = 16) -> Mailbox:
        self.boxes.append(Mailbox(most))
        return self.boxes[-1]

    def leave(self, box: Mailbox) -> None:
        self.boxes.remove(box)

    def tell(self, message: dict) -> None:
        for box in list(self.boxes):
            box.put(message)


class Notifier(StreamingQueryListener):
    """Calls back after each batch that had rows."""

    def __init__(self, tell: Callable[[dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.tell({"event": "ingest_done", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
