"""Removal of repeated byte strings: a suffix order by radix passes, only as deep as the threshold.

All positions of all texts are starts of suffixes; two of them belong together if their first 200 bytes are equal. The
first radix pass deals suffixes out by a digit that equal windows share wherever they stand: the smallest hash of
their 32-byte strings (the anchor) and its place in the window. Consecutive suffixes have the same anchor, so one
record holds some eighty of them, and anchors that occur once end their suffixes at once. The other passes split the
groups by four digits of 50 bytes each, most significant first, and drop what stands alone. What is left after the
last is exactly the repeated windows. Digits are compared by 64-bit hash.

Hot anchors' windows are dealt out by finer digits, of which equal ones are merged. Where a finer digit is still hot, its
windows are dealt out by all their bytes at once and only counted, so that no task holds a group of unbounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm import _text
from quillmeter.llm._store import Store

#: Bytes of a window, of an anchor, and anchors in a window.
WINDOW, ANCHOR = 200, 32
SPAN = WINDOW - ANCHOR + 1
DIGIT = 50
#: Bytes of a text handled at once, and of several short texts together.
PIECE = 1 << 19
#: Occurrences of an anchor above which its equal records are merged and dealt out by finer digits, of STEP windows each;
#: also different records of such a digit above which its windows are counted instead.
HOT, STEP = 1000, 8
#: Rows up to which a table of ids is broadcast (under 60 bytes each); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Begins the names of columns that stand beside those of an input for a while.
_OWN = "__repeats_"
_MASK = np.uint64((1 << 28) - 1)
_TEXTS = pa.schema([("tid", pa.int64()), ("h", pa.binary()), ("text", pa.binary())])
_ANCHORS = pa.schema([("hash", pa.int64()), ("tid", pa.int64()), ("at", pa.int64())])
_RECORDS = pa.schema([("digit", pa.int64()), ("tid", pa.int64()), ("start", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary()), ("rec", pa.int64())])
_RANGES = pa.schema([("tid", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a window or more with their SHA-256, each text once in a task."""
    seen: set[bytes] = set()
    base = TaskContext.get().partitionId() << 36
    for batch in batches:
        rows = [], [], []
        for t in batch.column(0).to_pylist():
            t = (t or "").encode()
            if len(t) >= WINDOW and (h := hashlib.sha256(t).digest()) not in seen:
                rows[0].append(base + len(seen))
                rows[1].append(h)
                rows[2].append(t)
                seen.add(h)
        yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _TEXTS, strict=True)], schema=_TEXTS)


def anchors(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, position, first window, last window) of the anchors of texts joined with a NUL after each.

    A window's anchor is the leftmost of its smallest 32-byte strings by hash; the windows of an anchor are consecutive.
    """
    c = _text.prefix_hash(buf)
    n = len(buf) - ANCHOR + 1
    if n < SPAN:
        return (np.zeros(0, np.int64),) * 4
    h = _text.mix((c[ANCHOR:] - c[:-ANCHOR]) * _text.powers(n)[1][:n])
    low = (h & ~_MASK) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: len(low) - SPAN + width], low[SPAN - width :])
    valid = np.zeros(len(low) + 1, np.int32)
    sizes = np.diff(bounds) - 1
    long = sizes >= WINDOW
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, (bounds[:-1] + sizes - WINDOW + 1)[long], -1)
    windows = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(windows):
        return (np.zeros(0, np.int64),) * 4
    owner = (low[windows] & _MASK).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (np.diff(windows) != 1)]))
    last = np.concatenate([new[1:] - 1, [len(windows) - 1]])
    return h[owner[new]].view(np.int64), owner[new], windows[new], windows[last]


def _pieces(ids: list[int], texts: list[bytes], piece: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(ids, offsets, parts) of about so many bytes; long texts come in parts that share all but one byte of a window."""
    out, size = ([], [], []), 0
    for k, t in zip(ids, texts, strict=True):
        for a in range(0, len(t) - WINDOW + 1, piece):
            part = t[a : a + piece + WINDOW - 1]
            for column, value in zip(out, (k, a, part), strict=True):
                column.append(value)
            size += len(part)
            if size >= piece:
                yield out
                out, size = ([], [], []), 0
    if out[0]:
        yield out


def _find_anchors(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offsets, parts in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), piece):
                buf, bounds = _text.join(parts)
                h, p, a, b = anchors(buf, bounds)
                k = np.searchsorted(bounds, p, side="right") - 1
                place = p - bounds[k] + np.array(offsets, np.int64)[k]
                at = (place << 16) | ((p - b) << 8) | (p - a)  # the anchor's place, and in its last and first window
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.array(ids, np.int64)[k]), pa.array(at)], schema=_ANCHORS)

    return run


def _records(hot: int):
    """The bytes that the windows of each shared anchor cover; rec is the hash of a hot anchor's record, null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = [], [], [], [], [], []
            for tid, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in found:
                    at, digit = x["at"], x["hash"]
                    place, low, high = at >> 16, (at >> 8) & 255, at & 255
                    cover = text[place - high : place - low + WINDOW]
                    row = digit, tid, place - high, high, cover, _hash(cover, digit, high) if x["count"] > hot else None
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            for i in range(0, len(rows[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(r[i : i + 20_000], f.type) for r, f in zip(rows, _RECORDS, strict=True)], schema=_RECORDS)

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of hot anchors' records (rec, digit, first, bytes, n) in steps, each dealt out by what all windows of
    the step have in common; part is the hash of a step's bytes, shift their place in the record."""
    for batch in batches:
        rows: tuple[list, ...] = [], [], [], [], [], [], []
        for rec, digit, high, cover, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low = high - len(cover) + WINDOW
            for step in range(low // STEP, high // STEP + 1):
                a, b = max(low, step * STEP), min(high, step * STEP + STEP - 1)
                core = high - step * STEP
                fine = _hash(cover[core : core - STEP + 1 + WINDOW], digit, step)
                own = cover[high - b : high - a + WINDOW]
                for column, value in zip(rows, (fine, _hash(own, fine, b), rec, high - b, b, own, n), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _STEPS, strict=True)], schema=_STEPS)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, start, mark, n) of the windows of steps (part, bytes, n); mark is a hash of 128 bits of all bytes."""
    for batch in batches:
        rows: tuple[list, ...] = [], [], [], []
        for part, cover, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(len(cover) - WINDOW + 1):
                mark = hashlib.blake2b(cover[at : at + WINDOW], digest_size=16).digest()
                for column, value in zip(rows, (part, at, mark, n), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, _MARKS, strict=True)], schema=_MARKS)


_MARKS = pa.schema([("part", pa.int64()), ("start", pa.int64()), ("mark", pa.binary()), ("n", pa.int64())])
_STEPS = pa.schema([("digit", pa.int64()), ("part", pa.int64()), ("rec", pa.int64()), ("shift", pa.int64()), ("first", pa.int32()), ("bytes", pa.binary()), ("n", pa.int64())])


def _hash(raw: bytes, key: int, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=key.to_bytes(8, "big", signed=True), salt=bytes([salt])).digest(), "big", signed=True)


def repeated_windows(group: np.ndarray, first: np.ndarray, covers: list[bytes], n: np.ndarray) -> np.ndarray:
    """For records sorted by group, whether each of their windows (in order) has an equal one; first is the anchor's
    place in a record's first window, n how often a record occurs. Equal records count once in the radix passes."""
    known: dict[tuple[int, int, bytes], int] = {}
    cls = np.fromiter((known.setdefault(x, len(known)) for x in zip(group.tolist(), first.tolist(), covers, strict=True)), np.int64, len(covers))
    times = np.bincount(cls, n, minlength=len(known))
    one = np.zeros(len(known), np.int64)
    one[cls[::-1]] = np.arange(len(cls))[::-1]
    sizes = np.fromiter((len(covers[i]) - WINDOW + 1 for i in one.tolist()), np.int64, len(one))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.repeat(times > 1, sizes)
    # Radix passes over the windows of groups with several different records.
    groups = group[one]
    several = np.concatenate([[False], groups[1:] == groups[:-1]]) | np.concatenate([groups[1:] == groups[:-1], [False]])
    live = np.flatnonzero(several)
    if len(live):
        buf, bounds = _text.join([covers[one[i]] for i in live.tolist()])
        c = _text.prefix_hash(buf)
        n = sizes[live]
        rec = np.repeat(np.arange(len(live)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where, window = bounds[:-1][rec] + step, begin[live][rec] + step
        place = first[one[live]][rec] - step
        label = _text.mix(groups[live].view(np.uint64)[rec] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for depth in range(0, WINDOW, DIGIT):
            digit = _text.span_hash(c, where + depth, where + depth + DIGIT)
            label = _text.mix(label ^ digit * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(depth))
            order = np.argsort(label)
            same = label[order[1:]] == label[order[:-1]]
            together = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
            label, where, window = label[together], where[together], window[together]
        flags[window] = True
    return np.concatenate([flags[begin[k] : begin[k + 1]] for k in cls.tolist()]) if len(cls) else flags


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The byte ranges that repeated windows cover, from records sorted by digit."""
    for table in _whole_groups(batches):
        group, tid, start, first = (table.column(i).to_numpy() for i in range(4))
        covers = table.column(4).to_pylist()
        flags = repeated_windows(group, first.astype(np.int64), covers, table.column(5).to_numpy())
        n = np.fromiter((len(x) - WINDOW + 1 for x in covers), np.int64, len(covers))
        rec = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        before = np.concatenate([[False], flags[:-1] & (rec[1:] == rec[:-1])])
        after = np.concatenate([flags[1:] & (rec[1:] == rec[:-1]), [False]])
        a, b = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
        yield pa.RecordBatch.from_arrays([pa.array(tid[rec[a]]), pa.array(start[rec[a]] + step[a]), pa.array(start[rec[b]] + step[b] + WINDOW)], schema=_RANGES)


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int = 8 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups, of about least bytes; a group is cut only between calls, so hot groups were split before."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cut(with_text: bool):
    """(removed bytes, maximal runs, SHA-256 of the rest, the rest if asked for) of texts and their ranges; null without
    ranges."""

    @F.arrow_udf("n_removed long, n_spans long, kept_sha256 string, rest string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            yield pa.array([r and _cut_text(t, r, with_text) for t, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True)], _CUT)

    return cut


_CUT = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("rest", pa.string())])


def _cut_text(text: bytes, ranges: list[dict], with_text: bool) -> dict:
    kept, at, removed, spans = [], 0, 0, 0
    for a, b in sorted((s + p["a"], s + p["b"]) for x in ranges for s in x["starts"] for p in x["parts"]):
        if a > at or not spans:
            kept.append(text[at:a])
            spans += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    rest = b"".join([*kept, text[at:]])
    return {"n_removed": removed, "n_spans": spans, "kept_sha256": hashlib.sha256(rest).hexdigest(), "rest": rest.decode("utf-8", "ignore") if with_text else None}


def _text_ranges(docs: DataFrame, store: Store, hot: int, piece: int) -> DataFrame:
    """(h, found): the ranges of repeated windows in each of the distinct texts that hold one."""
    texts = store.table(docs.select("text").mapInArrow(_distinct, "tid long, h binary, text binary"), "texts")
    firsts = texts.groupBy("h").agg(F.min("tid").alias("tid"), F.count("*").alias("n")).where("n > 1")
    again = texts.select("tid", "h").join(firsts.select("h", F.col("tid").alias("kept")), "h").where("tid <> kept")
    again = store.table(again.select("tid"), "again")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(again) if few else again, "tid", "left_anti")
    found = store.table(texts.select("tid", "text").mapInArrow(_find_anchors(piece), "hash long, tid long, at long"), "anchors")
    # Written first, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
    counts = store.table(found.groupBy("hash").count().where("count > 1"), "counts")
    shared = found.join(counts, "hash")
    shared = store.table(shared.select("tid", F.struct("at", "hash", "count").alias("x")), "shared")
    store.drop("anchors", "counts")
    lists = shared.groupBy("tid").agg(F.collect_list("x").alias("found"))  # as long as the text at most
    records = texts.select("tid", "text").join(lists, "tid").mapInArrow(_records(hot), "digit long, tid long, start long, first int, bytes binary, rec long")
    records = store.table(records, "records")
    store.drop("shared")
    # A hot record is often the same: it is resolved once, and its ranges are joined to where it stands.
    often, rare = records.where("rec is not null"), records.where("rec is null").drop("rec").withColumn("n", F.lit(1).cast("long"))
    ranges = store.table(_resolved(rare), "ranges").select("tid", F.array("start").alias("starts"), F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("end") - F.col("start")).alias("b"))).alias("parts"))
    once = often.groupBy("rec", "digit", "first").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n"))
    steps = store.table(once.mapInArrow(_steps, "digit long, part long, rec long, shift long, first int, bytes binary, n long"), "steps")
    parts = _step_ranges(steps, store, hot)
    parts = parts.select("part", F.struct(F.col("start").alias("a"), F.col("end").alias("b")).alias("p")).join(steps.select("rec", "part", "shift"), "part")
    parts = parts.groupBy("rec").agg(F.collect_list(F.struct((F.col("p.a") + F.col("shift")).alias("a"), (F.col("p.b") + F.col("shift")).alias("b"))).alias("parts"))
    # Written first, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
    where = store.table(often.groupBy("rec", "tid").agg(F.collect_list("start").alias("starts")), "where")  # as long as the text at most
    more = where.join(store.table(parts, "hot"), "rec").select("tid", "starts", "parts")
    ranges = ranges.union(more).groupBy("tid").agg(F.collect_list(F.struct("starts", "parts")).alias("found"))
    out = store.table(ranges.join(texts.select("tid", "h"), "tid").select("h", "found"), "found")
    store.drop(*(n for n in store.names if n != "found"))
    return out


def _step_ranges(steps: DataFrame, store: Store, hot: int) -> DataFrame:
    """(part, start, end) of the repeated windows of steps."""
    parts = store.table(steps.groupBy("digit", "part", "first").agg(F.first("bytes").alias("bytes"), F.sum("n").alias("n")), "step-parts")
    over = store.table(parts.groupBy("digit").count().where(F.col("count") > hot).select("digit", F.lit(True).alias("over")), "over")
    size = over.limit(BROADCAST_ROWS + 1).count()
    both = parts.join(F.broadcast(over) if size <= BROADCAST_ROWS else over, "digit", "left")
    few = both.where("over is null").select("digit", F.col("part").alias("tid"), F.lit(0).cast("long").alias("start"), "first", "bytes", "n")
    out = _resolved(few).select(F.col("tid").alias("part"), "start", "end")
    if size:
        marks = store.table(both.where("over").select("part", "bytes", "n").mapInArrow(_marks, "part long, start long, mark binary, n long"), "marks")
        # Written first, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
        again = store.table(marks.groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1").select("mark"), "marked")
        out = out.union(marks.join(again, "mark").select("part", "start", (F.col("start") + WINDOW).alias("end")))
    return store.table(out, "parts")


def _resolved(records: DataFrame) -> DataFrame:
    return records.repartition("digit").sortWithinPartitions("digit").mapInArrow(_resolve, "tid long, start long, end long")


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, with_text: bool = False, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """The kept columns of docs (default: all but the text) with n_bytes, n_removed, n_spans, kept_sha256 and, if asked
    for, kept: the text without every byte that a 200-byte string covers which also starts anywhere else.

    One row for each document. Strings are judged on the input; a text that occurs twice goes whole if it has 200 bytes
    or more. Null and shorter texts lose nothing; a null kept text stays null. Where a removed run ends inside a
    character, kept drops the character's other bytes. Columns of docs with the names added are replaced.
    """
    store = Store(docs.sparkSession, "repeats")
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    keep = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in own]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ranges = _text_ranges(docs.select(F.col(text).alias("text")), store, hot, piece)
    digest = F.unhex(F.sha2(body, 256))
    copies = docs.groupBy(digest.alias("h")).count().where("count > 1").select("h", F.lit(True).alias("copied"))
    known = store.table(copies.join(ranges, "h", "full").select(F.struct("copied", "found").alias(_OWN), F.col("h").alias(_OWN + "h")), "known")
    store.drop("found")
    rows = docs.select(*(f"`{c}`" for c in keep), F.col(text).alias(_OWN + "text"), digest.alias(_OWN + "h"), F.octet_length(body).cast("long").alias("n_bytes"))
    out = rows.join(known, _OWN + "h", "left")
    out = out.withColumn(_OWN + "gone", F.col(f"{_OWN}.copied").isNotNull() & (F.col("n_bytes") >= WINDOW))
    # Only texts that lose a part go through Python.
    ranges = F.when(~F.col(_OWN + "gone"), F.col(f"{_OWN}.found"))
    out = out.withColumn(_OWN, _cut(with_text)(F.when(ranges.isNotNull(), F.col(_OWN + "text")).cast("binary"), ranges))
    one = lambda c: F.col(f"{_OWN}.{c}")
    gone = F.col(_OWN + "gone")
    columns = {
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce(one("n_removed"), F.lit(0))),
        "n_spans": F.when(gone, 1).otherwise(F.coalesce(one("n_spans"), F.lit(0))).cast("long"),
        "kept_sha256": F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce(one("kept_sha256"), F.lower(F.hex(_OWN + "h")))),
    }
    if with_text:
        columns["kept"] = F.when(gone, "").when(one("rest").isNotNull(), one("rest")).otherwise(F.col(_OWN + "text"))
    return out.select(*(f"`{c}`" for c in keep), "n_bytes", *(c.alias(k) for k, c in columns.items()))
