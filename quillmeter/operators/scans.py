"""Folds over long series, in parallel: exponential means by a prefix scan, rows kept apart by pointer doubling.

A series may be longer than any task should read: it is cut by ranges of its order, parts are folded side by side, and only
what a part hands on to the next is folded one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.sources.tables import written

#: Groups of more distinct times are searched by pointer doubling, others by one pass of a task over each.
LONG = 1_000_000


def _composed(a: np.ndarray, b: np.ndarray) -> None:
    """All prefixes of the affine maps x -> a x + b, in place: maps compose associatively, so that after k rounds each row
    holds the last 2 ** k of them."""
    step = 1
    while step < len(a):
        b[step:] += a[step:, None] * b[:-step].copy()
        a[step:] *= a[:-step].copy()
        step *= 2


def _fold(values: int):
    """Means of each partition as if nothing came before it (_own), what is left of that which did (_left), and on the
    partition's last row what it hands on. Columns: _key, _a, values; the other columns pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, carry, left, first = None, np.zeros(values), 1.0, None
        held = None

        def done(batch: pa.RecordBatch, own: np.ndarray, lefts: np.ndarray, last: bool) -> pa.RecordBatch:
            end = np.zeros(len(own), bool)
            end[-1] = last
            head = pa.array([first[0]] * len(own), pa.string()), pa.array([first[1].tolist()] * len(own), pa.list_(pa.float64()))
            more = [pa.array(np.full(len(own), part, np.int32)), pa.array(own.tolist(), pa.list_(pa.float64())), pa.array(lefts), pa.array(end), *head]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_p", "_own", "_left", "_end", "_head", "_start"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield done(*held, False)
            keys, alpha = batch.column("_key"), batch.column("_a").to_numpy(zero_copy_only=False)
            v = np.stack([np.nan_to_num(batch.column(f"_v{k}").fill_null(0.0).to_numpy(zero_copy_only=False)) for k in range(values)], 1)
            new = np.ones(len(v), bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = key is not None and keys[0].as_py() != key
            if key is None:
                first = keys[0].as_py(), v[0]
            # A map for each row; the first row of a series forgets what came before.
            a, b = np.where(new, 0.0, 1 - alpha), np.where(new[:, None], v, alpha[:, None] * v)
            lefts = left * np.multiply.accumulate(a)
            b[0] += a[0] * carry
            a[0] = 0.0
            own = b
            _composed(a, own)
            key, carry, left = keys[-1].as_py(), own[-1], float(lefts[-1])
            held = batch, own, lefts
        if held:
            yield done(*held, True)

    return run


def emas(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, str], alpha: Column) -> DataFrame:
    """Exponential means (name: column), e[0] = v[0] and e[i] = alpha v[i] + (1 - alpha) e[i-1], over each series.

    Rows are range-partitioned by series and order; each partition is folded in one pass and written. A partition begins
    inside at most one series and hands on one value of it, so the partitions' ends (a row each) are folded on the driver
    and broadcast. No task reads more than its range, whatever the length of a series. Nulls count as 0, alpha is the same
    for all rows of a series, and the result doesn't depend on where partitions begin, but for rounding.
    """
    spark, n = df.sparkSession, len(values)
    kept = [*by, *order] if by else list(order)
    keyed = df.withColumns({"_key": F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit(""), "_a": alpha.cast("double"), **{f"_v{k}": F.col(v).cast("double") for k, v in enumerate(values.values())}})
    rows = keyed.repartitionByRange(*kept).sortWithinPartitions(*kept)
    more = "_p int, _own array<double>, _left double, _end boolean, _head string, _start array<double>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + more
    rows = written(rows.mapInArrow(_fold(n), schema), "scan")
    carries, before = [], (None, None)
    for e in rows.where("_end").select("_p", "_key", "_own", "_left", "_head", "_start").orderBy("_p").collect():  # a row for each partition
        carry = before[1] if e["_head"] == before[0] else np.array(e["_start"])
        carries.append((e["_p"], carry.tolist()))
        before = e["_key"], np.array(e["_own"]) + e["_left"] * carry
    told = spark.createDataFrame(carries, "_p int, _carry array<double>")
    out = rows.join(F.broadcast(told), "_p").withColumns({name: F.col("_own")[k] + F.col("_left") * F.col("_carry")[k] for k, name in enumerate(values)})
    return out.select(*df.columns, *values)


def _greedy(gap: int):
    """The kept rows of sorted groups, one pass: from each kept time to the first beyond the gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t = batch.column("_key"), batch.column("_t").to_numpy()
            cut = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
            kept: list[int] = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True):
                if a or keys[0].as_py() != key:
                    kept.append(a)
                    at, last = a + 1, int(t[a])
                else:
                    at = a
                while (at := at + int(np.searchsorted(t[at:b], last + gap, "right"))) < b:
                    kept.append(at)
                    last, at = int(t[at]), at + 1
            key = keys[-1].as_py()
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def _following(times: DataFrame, gap: int) -> DataFrame:
    """(_key, _t, _next): the first time of the group beyond the gap, null if there is none.

    A time's target lies in the cell of time + gap or is the first of the next cell that has any: cells are a sixteenth of
    a gap wide, so each is searched by itself, and only a row for each cell is ordered within a group.
    """
    width = max(1, gap // 16)
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    here = times.select("_key", cell(F.col("_t")).alias("_c"), F.col("_t").alias("_at"), F.lit(None).cast("long").alias("_from"))
    asks = times.select("_key", cell(F.col("_t") + gap).alias("_c"), (F.col("_t") + gap).alias("_at"), F.col("_t").alias("_from"))
    after = Window.partitionBy("_key", "_c").orderBy(F.col("_at").desc(), F.col("_from").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    # At equal times the asking row comes first among descending ones, so that what precedes it is later.
    inside = here.unionByName(asks).withColumn("_next", F.min(F.when(F.col("_from").isNull(), F.col("_at"))).over(after)).where("_from is not null")
    firsts = here.groupBy("_key", "_c").agg(F.min("_at").alias("_first"))
    asked = asks.select("_key", "_c").distinct()
    cells = firsts.join(asked, ["_key", "_c"], "full").withColumn("_later", F.min("_first").over(Window.partitionBy("_key").orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)))
    found = inside.join(cells.select("_key", "_c", "_later"), ["_key", "_c"], "left")
    return found.select("_key", F.col("_from").alias("_t"), F.coalesce("_next", "_later").alias("_next"))


def doubled(times: DataFrame, gap: int) -> DataFrame:
    """(_key, _t) of the times kept from each group's first on, by pointer doubling: after k rounds pointers jump 2 ** k
    kept times, and the times known to be kept double. A round is two joins on (group, time), so a long group is spread over
    all tasks; rounds are the logarithm of the longest chain."""
    jumps = written(_following(times, gap), "jumps")
    kept = written(times.groupBy("_key").agg(F.min("_t").alias("_t")), "kept")
    while True:
        reached = kept.join(jumps, ["_key", "_t"]).where("_next is not null").select("_key", F.col("_next").alias("_t"))
        reached = written(reached, "reached")
        if reached.limit(1).count() == 0:
            return kept
        kept = written(kept.unionByName(reached), "kept")
        beyond = jumps.select("_key", F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        jumps = written(jumps.where("_next is not null").join(beyond, ["_key", "_next"]).where("_far is not null").select("_key", "_t", F.col("_far").alias("_next")), "jumps")


def kept_apart(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], gap_s: float) -> DataFrame:
    """(by, ts, tie) of the rows that lie more than gap_s after the last row that was kept, from the first one on.

    Of rows at one time only the first by tie can be kept. Groups are walked in order by the task that has them, at the
    cost of a search for each kept row and without holding a group; groups of more than LONG times go by pointer doubling.
    """
    gap = int(gap_s * 1_000_000)
    keyed = df.where(F.col(ts).isNotNull()).withColumns({"_key": F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit(""), "_t": F.unix_micros(ts)})
    first = keyed.groupBy("_key", "_t").agg(F.min_by(F.struct(*by, *tie), F.struct(*tie)).alias("_r") if tie else F.first(F.struct(*by)).alias("_r")) if by or tie else keyed.select("_key", "_t", F.struct(F.lit(0).alias("_0")).alias("_r")).distinct()
    first = written(first, "times")
    long = first.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > LONG).select("_key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema)
    walked = lambda rows: rows.repartition("_key").sortWithinPartitions("_key", "_t").mapInArrow(_greedy(gap), schema)
    if long.limit(1).count() == 0:
        out = walked(first)
    else:
        long = written(long, "long")
        far = first.join(long, "_key", "left_semi")
        out = walked(first.join(long, "_key", "left_anti")).unionByName(far.join(doubled(far.select("_key", "_t"), gap), ["_key", "_t"], "left_semi"))
    return out.select(*(F.col(f"_r.{c}").alias(c) for c in by), F.timestamp_micros("_t").alias(ts), *(F.col(f"_r.{c}").alias(c) for c in tie))


def numbered(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """df with dense numbers from 0 in an order: parts are numbered side by side, and the counts of the parts before each
    (a row for each partition) are added. No task sorts all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "numbers")
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") - F.col("_first") + F.col("_before")).select(*df.columns, name)
