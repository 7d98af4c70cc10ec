"""Queries by name with the SQL that says the same, and helpers to write both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.session import prepare
from quillmeter.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Bucket middle in epoch seconds, for SQL.
_CENTER = "cast(floor(epoch_us({ts}) / 1000000.0 / {w}) * {w} + {h} as bigint)"


def query(sql: str | None = None):
    """Registers a function of a table reader, under its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: tables.read(prepare(spark), sf_dir, name))

        QUERIES[f.__name__] = run
        run.__name__, run.__doc__ = f.__name__, f.__doc__
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def center(width: int, ts: str = "ts") -> str:
    return _CENTER.format(ts=ts, w=width, h=width // 2)


def sec(c: Column | str) -> Column:
    return F.unix_seconds(c)


def r(c: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), digits)
