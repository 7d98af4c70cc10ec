"""Aggregates over time buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.time import bucket_center
from quillmeter.operators import quantiles


def totals(df: DataFrame, ts: str, width: int, by: Sequence[str], sums: dict[str, Column], name: str = "bucket") -> DataFrame:
    """Rows counted and columns summed by bucket and further keys."""
    return df.groupBy(bucket_center(F.col(ts), width).alias(name), *by).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def percentiles(df: DataFrame, ts: str, width: int, by: Sequence[str], value: str, points: Sequence[float], name: str = "bucket") -> DataFrame:
    """Exact interpolated percentiles p10, p50 and so on, by bucket and further keys."""
    rows = df.select(bucket_center(F.col(ts), width).alias(name), *by, F.col(value).alias("_value"))
    return quantiles.interpolated(rows, [name, *by], "_value", {f"p{round(100 * p)}": p for p in points})


def percentile_bands(df: DataFrame, ts: str, widths: Sequence[int], by: str, value: str, points: Sequence[float] = (0.1, 0.5, 0.9), every: str = "") -> DataFrame:
    """Percentiles for several widths, by a key and over all its values (key every), from one shuffle of the rows."""
    wide = df.where(F.col(value).isNotNull()).select("*", F.explode(F.array(*(F.struct(F.lit(w).alias("width"), bucket_center(F.col(ts), w).alias("bucket")) for w in widths))).alias("_b"))
    wide = wide.select(F.col("_b.width").alias("bucket_s"), F.col("_b.bucket").alias("bucket"), F.explode(F.array(F.col(by), F.lit(every))).alias(by), F.col(value).alias("_value"))
    return quantiles.interpolated(wide, ["bucket_s", "bucket", by], "_value", {f"p{round(100 * p)}": p for p in points})


def outlier_ends(share: float = 0.01, least: int = 100) -> dict[str, float]:
    """Percentiles just inside the shares, by name: at or within the last outlying row, in groups of least or more."""
    inside = (least * (1 - share) - 1) / (least - 1)
    return {"_low_end": 1 - inside, "_high_end": inside}


def outliers(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], share: float = 0.01, least: int = 100, ends: DataFrame | None = None) -> DataFrame:
    """The rows in the highest and lowest share of their group, at least one each, with kind; groups under least have none.

    Percentiles just inside the shares leave a few hundredths of a group to be ranked, so hot groups aren't sorted whole.
    ends has them (keys, n of values, and the names of outlier_ends) where a caller knows them already.
    """
    if ends is None:
        ends = quantiles.interpolated(df.where(F.col(value).isNotNull()).select(*keys, value), keys, value, outlier_ends(share, least))
    bounds = ends.where(F.col("n") >= least)
    bounds = bounds.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("n").alias("_n"), "_low_end", "_high_end")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    far = (F.col(value) <= F.col("_low_end")) | (F.col(value) >= F.col("_high_end"))
    rows = df.join(bounds, same & far)
    group, most = Window.partitionBy(*keys), F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    rows = rows.withColumns({"_high": F.row_number().over(group.orderBy(F.col(value).desc(), *tie)) <= most, "_low": F.row_number().over(group.orderBy(F.col(value).asc(), *tie)) <= most})
    return rows.where("_high or _low").withColumn("kind", F.when(F.col("_high"), "high").otherwise("low")).select(*df.columns, "kind")


def first_row_only(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Measures of a whole bucket kept on its first row and 0 on the others, so that sums over rows are right."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_nth", nth).withColumns({c: F.when(F.col("_nth") == 1, F.col(c)).otherwise(F.lit(0)) for c in columns}).drop("_nth")


def heatmap(df: DataFrame, ts: str, zone: str, sums: dict[str, Column]) -> DataFrame:
    """Totals by weekday (1 is Monday) and hour in a zone, daylight saving time included."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    return df.groupBy(F.extract(F.lit("dayofweek_iso"), local).cast("int").alias("dow"), F.hour(local).alias("hour")).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def margins(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A heat map with the sums of its rows and columns and of all; a summed key is -1."""
    out = grid.cube("dow", "hour").agg(*(F.sum(c).alias(c) for c in columns))
    return out.withColumns({k: F.coalesce(k, F.lit(-1)) for k in ("dow", "hour")})


def bins(df: DataFrame, ts: str, start, end, width: int, sums: dict[str, Column]) -> DataFrame:
    """Totals in bins counted from a start, empty ones included; the last bin ends where the range ends."""
    a, b = (F.unix_micros(F.lit(x).cast("timestamp")) for x in (start, end))
    at = F.floor((F.unix_micros(F.col(ts)) - a) / F.lit(width * 1_000_000))
    last = F.greatest(F.lit(0), F.ceil((b - a) / F.lit(width * 1_000_000)) - 1)
    rows = df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end))).groupBy(F.least(at, last).alias("bin")).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    every = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("bin"))
    out = every.join(rows, "bin", "left").select("bin", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *sums)))
    edge = lambda k: F.timestamp_micros((a + F.col("bin") * width * 1_000_000 + F.lit(k * width * 1_000_000)).cast("long"))
    return out.withColumns({"bin_start": edge(0), "bin_end": F.least(edge(1), F.lit(end).cast("timestamp"))})
