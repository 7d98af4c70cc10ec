"""Tables in parts, whose versions share every part that an update left alone.

Below a root, `name/v=3/day=2026-01-01` is a part that version 3 wrote; `_manifest/v=5` lists the parts that version 5
consists of, whoever wrote them. An update writes the parts it touches beside the old ones and then its manifest, so readers
keep the version they have, and what is written follows what changed. A manifest has a row for each day of a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillmeter.sources.tables import delete, exists, folders

_MANIFEST = "name string, part string, path string, schema string"


@dataclass(frozen=True)
class Version:
    """The parts (value of the part column: path) of each table, and the tables' schemas."""

    spark: SparkSession
    root: str
    number: int = 0
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    def __contains__(self, name: str) -> bool:
        return name in self.schemas

    def read(self, name: str, parts: Iterable | None = None) -> DataFrame:
        """A table, or only some of its parts: filters on the part column skip folders, like in any partitioned table."""
        schema = StructType.fromJson(json.loads(self.schemas[name]))
        held = self.parts[name]
        paths = [held[p] for p in (held if parts is None else sorted(set(map(str, parts)) & set(held)))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).drop("v")


def latest(spark: SparkSession, root: str) -> Version:
    """The last complete version, number 0 without tables before the first."""
    done = [int(f[2:]) for f in folders(spark, f"{root}/_manifest") if exists(spark, f"{root}/_manifest/{f}/_SUCCESS")]
    return _version(spark, root, max(done)) if done else Version(spark, root)


def _version(spark: SparkSession, root: str, number: int) -> Version:
    parts: dict[str, dict[str, str]] = {}
    schemas: dict[str, str] = {}
    for row in spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest/v={number}").collect():  # days times tables
        parts.setdefault(row["name"], {})
        schemas[row["name"]] = row["schema"] or schemas.get(row["name"])
        if row["path"]:
            parts[row["name"]][row["part"]] = row["path"]
    return Version(spark, root, number, parts, schemas)


class Change:
    """The next version while it is made: what isn't put stays as it was."""

    def __init__(self, old: Version):
        self.old, self.spark, self.root, self.number = old, old.spark, old.root, old.number + 1
        self.now = Version(old.spark, old.root, self.number, {k: dict(v) for k, v in old.parts.items()}, dict(old.schemas))
        self.written: list[str] = []

    def put(self, name: str, rows: DataFrame, part: str | None = None, touched: Iterable | None = None, order: tuple[str, ...] = (), add: bool = False) -> DataFrame:
        """Writes a table's rows, or all rows of the touched parts, and returns what was written.

        part is the column that tells parts; a table without one is one part. Touched parts that have no row go. Rows are
        sorted by order inside files. With add the rows join what is there, as a part of this version's own.
        """
        path = f"{self.root}/{name}/v={self.number}"
        if part:
            rows = rows.select(*(c for c in rows.columns if c != part), part).repartitionByRange(part, *order).sortWithinPartitions(part, *order)
        elif order:
            rows = rows.sortWithinPartitions(*order)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(part) if part else writer).parquet(path)
        made = {f.split("=", 1)[1]: f"{path}/{f}" for f in folders(self.spark, path)} if part else {str(self.number): path}
        held = self.now.parts.get(name, {})
        gone = set() if add else set(held) if touched is None else set(map(str, touched))
        self.now.parts[name] = {k: v for k, v in held.items() if k not in gone} | made
        self.now.schemas[name] = rows.schema.json()
        self.written += made.values()
        return self.now.read(name, made)

    def commit(self) -> Version:
        """Makes the version visible; fails if another one took its number."""
        rows = [(name, part, path, None) for name, held in self.now.parts.items() for part, path in held.items()]
        rows += [(name, None, None, schema) for name, schema in self.now.schemas.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/_manifest/v={self.number}")
        return self.now


def prune(spark: SparkSession, root: str, keep: int) -> None:
    """Deletes all but the last keep versions, and the parts that none of those has."""
    numbers = sorted(int(f[2:]) for f in folders(spark, f"{root}/_manifest"))
    for number in numbers[:-keep]:
        delete(spark, f"{root}/_manifest/v={number}")
    kept = [_version(spark, root, n) for n in numbers[-keep:]]
    used = {path for v in kept for held in v.parts.values() for path in held.values()}
    for name in {n for v in kept for n in v.schemas}:
        for version in folders(spark, f"{root}/{name}"):
            path = f"{root}/{name}/{version}"
            if path in used or int(version[2:]) > numbers[-1]:
                continue
            parts = [f"{path}/{f}" for f in folders(spark, path)]
            if not used & set(parts):
                delete(spark, path)
            else:
                for part in parts:
                    if part not in used:
                        delete(spark, part)
