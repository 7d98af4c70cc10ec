"""Table writers that bring stored tables up to date."""

from __future__ import annotations

import atexit
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replaced(old: DataFrame, new: DataFrame, files: DataFrame, key: str = "file_key") -> DataFrame:
    """old without the rows of the given files, and all rows of new: a file's rows go and come together, also if it has
    none any more."""
    return old.join(files.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def projects(old: DataFrame | None, files: DataFrame) -> DataFrame:
    """(project_id, display_name, first_seen, last_seen) of the stored projects and those of files."""
    seen = files.select("project_id", F.col("last_modified").alias("first_seen"), F.col("last_modified").alias("last_seen"))
    rows = seen if old is None else old.select(seen.columns).unionByName(seen)
    return rows.groupBy("project_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).withColumn("display_name", F.col("project_id"))


def without_orphans(table: DataFrame, listing: DataFrame, key: str = "file_key") -> DataFrame:
    """The rows whose file is still listed; an empty listing keeps everything, since it is more likely a failed one."""
    if listing.limit(1).count() == 0:
        return table
    return table.join(listing.select(key).distinct(), key, "left_semi")


def write_by_day(table: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet by day, sorted by time within files, so that range filters skip days and row groups. Only the days that
    table holds are replaced."""
    day = F.coalesce(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    out = table.withColumn("day", day).repartitionByRange("day", ts).sortWithinPartitions("day", ts)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, key: str = "file_key", buckets: int = 64, blooms: tuple[str, ...] = ()) -> DataFrame:
    """Saves a table of the session's catalog in buckets by a key, sorted by it in each, and reads it.

    Tables in as many buckets of one key are joined and grouped by it without a shuffle; for joins on further keys as well,
    set spark.sql.requireAllClusterKeysForCoPartition to false in the session that reads them. Columns of blooms get Parquet
    Bloom filters, so that a look for one value (a session, a request) skips the row groups without it.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key)
    for column in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", "100000")
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder that hold data (name=value), none if it isn't there."""
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in (fs.listStatus(where) if fs.exists(where) else ()) if s.isDirectory() and "=" in s.getPath().getName())


@contextmanager
def only_one(spark: SparkSession, root: str, stale_s: float = 600, beat_s: float = 60):
    """Holds a lock file below a folder while a block runs; a RuntimeError if another holds it.

    The holder writes the file anew every beat_s, so one that is older than stale_s was left by a process that died, and is
    taken over, while a long update keeps its own. Stores without an atomic create let two in at once: each reads back who
    wrote last, and gives up if it was the other. The block gets a function that raises unless the lock is still its own.
    """
    fs, where = _fs(spark, f"{root}/_lock")
    me, stop, mine = uuid.uuid4().hex, threading.Event(), threading.Lock()

    def write(overwrite: bool) -> None:
        out = fs.create(where, overwrite)
        out.write(bytearray(me.encode()))
        out.close()

    def held() -> str:
        words = spark._jvm.java.util.Scanner(fs.open(where))
        return words.nextLine() if words.hasNextLine() else ""

    def owned() -> None:
        with mine:
            if not fs.exists(where) or held() != me:
                raise RuntimeError(f"another update of {root} took the lock")

    def beat() -> None:
        while not stop.wait(beat_s):
            with suppress(Exception), mine:  # a beat that fails is made up for by the next
                if held() == me:
                    write(True)

    if fs.exists(where) and time.time() - fs.getFileStatus(where).getModificationTime() / 1000 > stale_s:
        fs.delete(where, False)
    try:
        write(False)  # fails if it is there
    except Exception as e:
        raise RuntimeError(f"another update of {root} is running") from e
    owned()
    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield owned
    finally:
        stop.set()
        thread.join()
        with suppress(RuntimeError):
            owned()
            fs.delete(where, False)


_own: dict[str, str] = {}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir (or the context's checkpoint folder), which driver and executors share; on a
    local master without either, below a temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="quillmeter-"))
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # at exit the JVM may be gone; the folder is then left to its owner
        delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read again from a folder of its own: what follows neither computes it again nor inlines its
    expressions."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; times without zone are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
