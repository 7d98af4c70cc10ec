"""Series in time order: smoothing, sums so far, sessions by gap, shifts, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.operators import quantiles, scans

DAY = 86400


def _ordered(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)


def ema(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float | Column = 0.15, name: str = "ema") -> DataFrame:
    """Exponential mean, e[0] = v[0] and e[i] = alpha v[i] + (1 - alpha) e[i-1], over each series."""
    return emas(df, by, order, {name: value}, alpha)


def emas(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Mapping[str, str], alpha: float | Column = 0.15) -> DataFrame:
    """Exponential means (name: column) of several columns at once, by a prefix scan (see scans.emas)."""
    return scans.emas(df, by, order, dict(values), F.lit(alpha) if isinstance(alpha, (int, float)) else alpha)


def display_alpha(n: Column) -> Column:
    """The smoothing that n points are drawn with."""
    return F.greatest(F.lit(0.15), F.lit(2.0) / (n + 1))


def so_far(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Running sums, named cum_ and the column."""
    w = _ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"cum_{c}": F.sum(c).over(w) for c in columns})


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / 1e6


def with_previous(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str] = (), name: str = "_p") -> DataFrame:
    """df with the time of the row before in its series, null for the first.

    A single series of all rows (no by) is read in blocks of an hour, side by side: the first row of a block follows the
    last time of an earlier one, which a table of one row for each hour tells. The blocks are left as _hour.
    """
    if by:
        return df.withColumn(name, F.lag(ts).over(_ordered(by, [ts, *tie])))
    rows = df.withColumn("_hour", F.date_trunc("hour", ts))
    last = rows.groupBy("_hour").agg(F.max(ts).alias("_last"))
    before = last.select(F.col("_hour").alias("_h"), F.lag("_last").over(Window.orderBy("_hour")).alias("_before"))  # hours: the calendar bounds them
    rows = rows.join(F.broadcast(before), F.col("_hour").eqNullSafe(F.col("_h")))
    return rows.withColumn(name, F.coalesce(F.lag(ts).over(_ordered(["_hour"], [ts, *tie])), "_before")).drop("_h", "_before")


def with_session(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str] = (), gap_s: int = 1800) -> DataFrame:
    """df with session_no: a gap of more than gap_s begins a new one."""
    rows = with_previous(df, by, ts, tie).withColumn("_new", F.coalesce((_seconds(F.col(ts), F.col("_p")) > gap_s).cast("int"), F.lit(1))).drop("_p")
    so_far = F.sum("_new").over(_ordered(by or ["_hour"], [ts, *tie]).rowsBetween(Window.unboundedPreceding, 0))
    if by:
        return rows.withColumn("session_no", so_far).drop("_new")
    begun = rows.groupBy("_hour").agg(F.sum("_new").alias("_k"))
    begun = begun.select(F.col("_hour").alias("_h"), F.coalesce(F.sum("_k").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begun"))
    rows = rows.join(F.broadcast(begun), F.col("_hour").eqNullSafe(F.col("_h")))  # hours
    return rows.withColumn("session_no", F.col("_begun") + so_far).drop("_new", "_hour", "_h", "_begun")


def sessions(df: DataFrame, by: Sequence[str], ts: str, sums: dict[str, Column], gap_s: int = 1800, least: int = 1) -> DataFrame:
    """(by, start, end, events, sums) of the sessions with at least so many events. One shuffle, with map-side merging."""
    window = F.session_window(ts, f"{gap_s} seconds")
    out = df.groupBy(*by, window).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"), *(F.sum(c).alias(k) for k, c in sums.items()))
    return out.where(F.col("events") >= least).drop("session_window")


def hourly_rates(found: DataFrame, columns: Sequence[str], floor_s: float = 60) -> DataFrame:
    """Sessions with mid, dur_h (a minute at least) and each sum for an hour of it."""
    hours = F.greatest(_seconds(F.col("end"), F.col("start")), F.lit(float(floor_s))) / 3600
    mid = F.timestamp_micros(((F.unix_micros("start") + F.unix_micros("end")) / 2).cast("long"))
    return found.withColumns({"dur_h": hours, "mid": mid}).withColumns({f"{c}_per_h": F.col(c) / F.col("dur_h") for c in columns})


def gap_boundaries(df: DataFrame, by: Sequence[str], ts: str, gap_s: int = 18000, middle: bool = False) -> DataFrame:
    """(by, boundary) where a long pause lies: the time after a gap of at least gap_s, or the middle of one that is longer."""
    rows = with_previous(df, by, ts).withColumn("_t", F.col(ts))
    gap = _seconds(F.col("_t"), F.col("_p"))
    at = F.timestamp_micros(((F.unix_micros("_t") + F.unix_micros("_p")) / 2).cast("long")) if middle else F.col("_t")
    return rows.where(gap > gap_s if middle else gap >= gap_s).select(*by, at.alias("boundary"))


def session_slices(df: DataFrame, by: Sequence[str], ts: str, columns: Sequence[str], gap_s: int = 1800, slice_s: int = 1800, least: int = 3) -> DataFrame:
    """Rates for an hour in slices counted from a session's start; the last slice ends with the session, whose last event
    it leaves out. Sessions of fewer events have none."""
    rows = with_session(df, by, ts, gap_s=gap_s)
    whole = Window.partitionBy(*by, "session_no")
    rows = rows.withColumns({"_start": F.min(ts).over(whole), "_end": F.max(ts).over(whole), "_n": F.count("*").over(whole)}).where((F.col("_n") >= least) & (F.col(ts) < F.col("_end")))
    at = F.floor(_seconds(F.col(ts), F.col("_start")) / slice_s)
    out = rows.groupBy(*by, "session_no", "_start", "_end", at.alias("slice")).agg(*(F.sum(c).alias(c) for c in columns))
    length = F.least(F.lit(float(slice_s)), _seconds(F.col("_end"), F.col("_start")) - F.col("slice") * slice_s)
    mid = F.timestamp_micros((F.unix_micros("_start") + (F.col("slice") * slice_s + length / 2) * 1_000_000).cast("long"))
    return out.select(*by, "session_no", "slice", mid.alias("mid"), *((F.col(c) / (F.greatest(length, F.lit(60.0)) / 3600)).alias(f"{c}_per_h") for c in columns))


def shifts(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], value: str, back: int = 10, factor: float = 2.0) -> DataFrame:
    """(by, ts, tie, ratio, direction) where a value reaches factor times, or falls to its inverse of, the mean of the
    rows before it; only with back rows before it and a positive mean."""
    w = _ordered(by, [ts, *tie])
    before = w.rowsBetween(-back, -1)
    rows = df.withColumns({"_mean": F.avg(value).over(before), "_n": F.count("*").over(before)}).where(f"_n = {back} and _mean > 0").withColumn("ratio", F.col(value) / F.col("_mean"))
    out = rows.where((F.col("ratio") >= factor) | (F.col("ratio") <= 1 / factor))
    return out.select(*by, ts, *tie, "ratio", F.when(F.col("ratio") > 1, "up").otherwise("down").alias("direction"))


def shift_clusters(found: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], apart_s: float = DAY) -> DataFrame:
    """The first shift of each cluster."""
    return scans.kept_apart(found, by, ts, [*tie, "ratio", "direction"], apart_s)


def parallel_batches(df: DataFrame, by: Sequence[str], ts: str, tie: Sequence[str], gap_s: float = 2.0) -> DataFrame:
    """df with batch_no, batch_size and batch_index: rows that follow each other in less than gap_s belong together."""
    w = _ordered(by, [ts, *tie])
    new = F.coalesce((_seconds(F.col(ts), F.lag(ts).over(w)) >= gap_s).cast("int"), F.lit(1))
    rows = df.withColumn("_new", new).withColumn("batch_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    batch = Window.partitionBy(*by, "batch_no")
    return rows.withColumns({"batch_size": F.count("*").over(batch), "batch_index": F.row_number().over(batch.orderBy(ts, *tie)) - 1}).drop("_new")


def top_or_other(df: DataFrame, key: str, weight: str, n: int, other: str = "Other") -> DataFrame:
    """df with the keys of the n largest sums of a weight; all other keys become one."""
    total = df.groupBy(key).agg(F.sum(weight).alias("_w")).orderBy(F.desc("_w"), key).limit(n).select(F.col(key).alias("_k"))
    return df.join(F.broadcast(total), F.col(key) == F.col("_k"), "left").withColumn(key, F.coalesce("_k", F.lit(other))).drop("_k")  # n rows


def promoted_shares(df: DataFrame, bucket: str, key: str, n: str, top: int = 7, other: str = "Other") -> DataFrame:
    """(bucket, key, n, share): keys that are among the top of some bucket by themselves, the others as one, each as its
    share of the bucket."""
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(F.desc(n), key))
    chosen = df.withColumn("_r", rank).where(F.col("_r") <= top).select(F.col(key).alias("_k")).distinct()
    rows = df.join(chosen, F.col(key) == F.col("_k"), "left").groupBy(bucket, F.coalesce("_k", F.lit(other)).alias(key)).agg(F.sum(n).alias(n))
    return rows.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(bucket)))


def error_rates(df: DataFrame, bucket: str, key: str, total: str, errors: str, top: int = 5) -> DataFrame:
    """(bucket, series, total, errors, rate) for all keys together, the top keys by total, and the others together."""
    named = top_or_other(df.select(bucket, key, total, errors), key, total, top)
    rows = named.withColumn("series", F.explode(F.array(F.lit("Aggregate"), F.col(key))))
    out = rows.groupBy(bucket, "series").agg(F.sum(total).alias(total), F.sum(errors).alias(errors)).where(F.col(total) > 0)
    return out.withColumn("rate", F.col(errors) / F.col(total))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """Percentiles as members of the sorted group: the one at place floor(n q), the last at most."""
    return quantiles.nearest(df, by, value, {f"q{round(100 * q)}": q for q in points})


def edges(df: DataFrame, by: Sequence[str], x: str, y: str, half: float, log: bool = False) -> DataFrame:
    """A series drawn to its buckets' outer borders: half a bucket before and after, on the line through its end points,
    cut at 0; with log on that of the logarithms, for which values of 0 and less count as the smallest positive one of the
    frame. The points themselves stay as they are."""
    rows, level, drawn = df, F.col(y), lambda c: F.greatest(F.lit(0.0), c)
    if log:
        rows = df.crossJoin(F.broadcast(df.agg(F.min(F.when(F.col(y) > 0, F.col(y))).alias("_least"))))  # one row
        level, drawn = F.log10(F.when(F.col(y) > 0, F.col(y)).when(F.col(y).isNotNull(), F.col("_least"))), lambda c: F.pow(F.lit(10.0), c)
    rows, w = rows.withColumn("_v", level), _ordered(by, [x])
    after, before = F.lead("_v").over(w), F.lag("_v").over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    end = lambda other: drawn(1.5 * F.col("_v") - 0.5 * F.coalesce(other, F.col("_v")))
    rows = rows.select(*by, F.col(x), F.col(y), F.when(first & F.col("_v").isNotNull(), end(after)).alias("_a"), F.when(last & F.col("_v").isNotNull(), end(before)).alias("_b"))
    points = F.filter(F.array(F.struct((F.col(x) - half).alias("x"), F.col("_a").alias("y")), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), F.struct((F.col(x) + half).alias("x"), F.col("_b").alias("y"))), lambda p: p["y"].isNotNull())
    return rows.select(*by, F.explode(points).alias("p")).select(*by, F.col("p.x").alias(x), F.col("p.y").alias(y))


def renormalised(df: DataFrame, x: str, y: str) -> DataFrame:
    """Shares that sum to one at each place again, as after drawing each series to its borders by itself."""
    total = F.sum(y).over(Window.partitionBy(x))
    return df.withColumn(y, F.when(total > 0, F.col(y) / total).otherwise(0.0))


def densified(df: DataFrame, by: Sequence[str], x: str, y: str, points: int = 32) -> DataFrame:
    """Points between each two neighbours on a straight line, and the last one."""
    w = _ordered(by, [x])
    rows = df.withColumns({"_x": F.lead(x).over(w), "_y": F.lead(y).over(w)})
    steps = rows.withColumn("_s", F.explode(F.when(F.col("_x").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(points - 1)))))
    part = F.col("_s") / F.lit(float(points))
    on = lambda c, d: F.col(c) + F.coalesce(F.col(d) - F.col(c), F.lit(0.0)) * part
    return steps.select(*by, on(x, "_x").alias(x), on(y, "_y").alias(y))


def traces(turns: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Turns with an origin of zeros before each series."""
    start = turns.select(*by).distinct().select(*by, F.lit(0).alias("idx"), *(F.lit(0).cast("long").alias(c) for c in columns))
    return turns.select(*by, "idx", *columns).unionByName(start)
