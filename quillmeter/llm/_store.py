"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Seconds between two collections of the driver's garbage.
GC_S = 5.0


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; on a local master without either, a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="quillmeter-"))
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch: batches hold whole texts, and two tasks' batches must fit beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


class Store:
    """A folder of its own for one run. Written tables cut the lineage and survive lost executors.

    drop() removes tables that nothing reads any more; what the result reads stays until the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []
        self.collected = 0.0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self.names.append(name)
        df.write.option("compression", codec).parquet(self.path(name))
        # Shuffle files go when the driver's collector finds their plan unused, which may be long after: now is the time.
        if time.monotonic() - self.collected > GC_S:
            self.spark._jvm.System.gc()
            self.collected = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        with contextlib.suppress(Exception):  # at exit the JVM may be gone; the folder is then left to its owner
            self.drop("")
