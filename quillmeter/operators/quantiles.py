"""Exact percentiles of groups of any size.

`percentile` keeps a group's distinct values in one task. Groups of more than HOT rows are selected from instead: the range
of values that must hold a rank is cut into cells, one pass counts the cells, and the one that holds the rank is the next
range, until few values are left.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.sources.tables import written

#: Rows from which a group is selected from, cells of a range, and rows of a range that are sorted.
HOT, CELLS, SORTED = 1_000_000, 1024, 10_000


def _same(by: Sequence[str]) -> Column:
    return reduce(and_, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by), F.lit(True))


def _joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """left and the other columns of right, null keys being equal."""
    more = [] if how in ("left_semi", "left_anti") else [F.col(f"r.{c}") for c in right.columns if c not in by]
    return left.alias("l").join(right.alias("r"), _same(by), how).select("l.*", *more)


def select_ranks(rows: DataFrame, by: Sequence[str], value: str, sizes: DataFrame, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """(by, n, v) for each group of sizes (by, n): v holds the values at some places of its sorted values, in their order.

    ranks gives the places, from 0, of a column with the group's size. Every round reads the rows of the ranges that are
    left; it cuts a range of distinct values to its 1024th, so that three are enough for values that fill their range, and
    extremes cost another one for each thousandfold of the spread. Cells are counted on the map side.
    """
    rows = written(rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null"), "values")
    ends = _joined(rows, sizes, by, "left_semi").groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_m"))
    found = _joined(ends, sizes, by).select(*by, "n", "_lo", "_hi", "_m", F.lit(0).cast("long").alias("_below"), F.posexplode(F.array(*(r.cast("long") for r in ranks(F.col("n"))))).alias("_i", "_r"))
    small, rest = (F.col("_m") <= SORTED) | (F.col("_lo") == F.col("_hi")), F.col("_v")
    ranges, done = written(found, "ranges"), []
    while True:
        done.append(ranges.where(small))
        ranges = ranges.where(~small)
        if ranges.limit(1).count() == 0:
            break
        hit = _joined(rows, ranges, by).where((rest >= F.col("_lo")) & (rest <= F.col("_hi")))
        part = (rest / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        finite = F.abs(F.col("_lo")) < float("inf")
        even = F.when(finite & (F.abs(F.col("_hi")) < float("inf")), F.least(F.floor(part * CELLS), F.lit(CELLS - 1))).otherwise(F.when(rest == F.col("_lo"), 0).when(rest == F.col("_hi"), CELLS - 1).otherwise(CELLS // 2))
        counted = hit.withColumn("_cell", even.cast("int")).groupBy(*by, "n", "_i", "_r", "_below", "_cell").agg(F.count("*").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        so_far = Window.partitionBy(*by, "_i").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)  # at most CELLS rows
        counted = counted.withColumn("_to", F.col("_below") + F.sum("_m").over(so_far)).where((F.col("_r") < F.col("_to")) & (F.col("_r") >= F.col("_to") - F.col("_m")))
        ranges = written(counted.withColumn("_below", F.col("_to") - F.col("_m")).select(found.columns), "ranges")
    last = reduce(DataFrame.unionByName, done)
    equal = last.where("_lo = _hi").select(*by, "n", "_i", F.col("_lo").alias("_v"))
    near = _joined(rows, last.where("_lo < _hi"), by).where((rest >= F.col("_lo")) & (rest <= F.col("_hi")))
    place = F.col("_below") + F.row_number().over(Window.partitionBy(*by, "_i").orderBy("_v")) - 1  # at most SORTED rows
    near = near.withColumn("_at", place).where("_at = _r").select(*by, "n", "_i", "_v")
    return equal.unionByName(near).groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("v"))


def _split(df: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame | None]:
    """df without its hot groups, and these groups' sizes (by, n), or None if there are none."""
    hot = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    if not hot.limit(1).count():
        return df, None
    hot = written(hot, "hot")
    return _joined(df, hot, by, "left_anti"), hot


def selected(df: DataFrame, by: Sequence[str], value: str, sizes: DataFrame, points: Mapping[str, float]) -> DataFrame:
    """(by, n, points) of the groups of sizes (by, n): percentiles between the members at both sides of place (n - 1) p."""
    at = lambda n, p: (n - 1).cast("double") * F.lit(float(p))
    found = select_ranks(df, by, value, sizes, lambda n: [f(at(n, p)) for p in points.values() for f in (F.floor, F.ceil)])

    def between(k: int, p: float) -> Column:
        place, low, high = at(F.col("n"), p), F.col("v")[2 * k], F.col("v")[2 * k + 1]
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*by, "n", *(between(k, p).alias(name) for k, (name, p) in enumerate(points.items())))


def interpolated(df: DataFrame, by: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """(by, n, points): exact percentiles between members, as `percentile` gives them; n counts all rows of a group. All
    points come from one count of a group's values."""
    rest, hot = _split(df, by, value)
    found = F.percentile(F.col(value).cast("double"), F.array(*(F.lit(float(p)) for p in points.values())))
    out = rest.groupBy(*by).agg(F.count("*").alias("n"), found.alias("_p")).select(*by, "n", *(F.col("_p")[i].alias(k) for i, k in enumerate(points)))
    if hot is None:
        return out
    found = selected(df, by, value, hot, points)
    whole = _joined(df, hot, by, "left_semi").groupBy(*by).agg(F.count("*").alias("_all"))
    found = _joined(found, whole, by)
    return out.unionByName(found.select(*by, F.col("_all").alias("n"), *points))


def nearest(df: DataFrame, by: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """(by, n, points): members of the sorted group at place floor(n q), the last at most; nulls aren't counted."""
    rest, hot = _split(df, by, value)
    w, kind = Window.partitionBy(*by), df.schema[value].dataType
    rows = rest.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    at = lambda n, q: F.least(n - 1, F.floor(n * F.lit(q)))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.max(F.when(F.col("_i") == at(F.col("_n"), q), F.col(value))).alias(k) for k, q in points.items()))
    if hot is None:
        return out
    found = select_ranks(df, by, value, hot, lambda n: [at(n, q) for q in points.values()])
    return out.unionByName(found.select(*by, "n", *(F.col("v")[k].cast(kind).alias(name) for k, name in enumerate(points))))
