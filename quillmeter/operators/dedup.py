"""Duplicates across files: which of the rows that share an id counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(df: DataFrame, uuid: str = "uuid", order: list[str | Column] = ("file_key", "line_num"), name: str = "is_canonical") -> DataFrame:
    """df with a flag: the first row of each id in the given order, and every row without an id.

    Rows without an id are ranked by themselves under salted keys, so that many of them don't meet in one task.
    """
    salt = F.when(F.col(uuid).isNull(), F.xxhash64(*order) % 1024)
    nth = F.row_number().over(Window.partitionBy(F.col(uuid), salt).orderBy(*order))
    return df.withColumn(name, F.col(uuid).isNull() | (nth == 1))


def first_of(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def distinct_requests(df: DataFrame, uuid: str = "uuid") -> DataFrame:
    """One row for each id, by time then place; rows without an id are told apart by file and line."""
    return first_of(df, [F.coalesce(F.col(uuid), F.concat_ws(":", "file_key", "line_num"))], [F.col("ts").asc_nulls_last(), "file_key", "line_num"])
