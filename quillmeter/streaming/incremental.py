"""Stored tables brought up to date at the cost of what changed.

What changed is a set of files: their old rows go, their new rows come. From these follow the days of requests and tool
calls to be written anew, the requests elsewhere that become or cease to be the one that counts among copies, and the
groups of the rollups that differ. Everything else stays where it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.operators import rollups
from quillmeter.sources import tables, versions

#: Parts of the table of files, and generations of claims before they become one.
BUCKETS, GENERATIONS = 64, 32
_DAY = "1970-01-01"


def day_of(ts: str):
    """The day that a row is stored under; rows without a time have one of their own."""
    return F.coalesce(F.to_date(ts), F.lit(_DAY).cast("date")).alias("day")


def _bucket():
    return F.pmod(F.xxhash64("file_key"), F.lit(BUCKETS)).cast("int")


def _values(df: DataFrame, column: str) -> list:
    """The distinct values of a column of days or buckets."""
    return [r[0] for r in df.select(column).distinct().collect()]


def winners(claims: DataFrame) -> DataFrame:
    """(uuid, one): for each id the first of its rows by file and line; combined on the map side, no sort of an id's rows."""
    return claims.groupBy("uuid").agg(F.min(F.struct("file_key", "line_num", "day")).alias("one"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_key, line_num, day, is_canonical) of rows that count no more, or count now, after a change of winners."""
    both = before.withColumnRenamed("one", "was").join(after.withColumnRenamed("one", "now"), "uuid", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    flag = lambda c, v: F.when(F.col(c).isNotNull(), F.struct(f"{c}.*", F.lit(v).alias("is_canonical")))
    return both.select(F.explode(F.array_compact(F.array(flag("was", False), flag("now", True)))).alias("m")).select("m.*")


def apply(old: versions.Version, files: DataFrame, records: DataFrame, tool_uses: DataFrame, gone: DataFrame, work: str, more: Callable[[versions.Change], None] | None = None) -> versions.Change:
    """The next version of all tables, not committed yet, of the new rows of changed files and the keys of vanished ones.

    files, records and tool_uses hold the changed files' rows, whole; a file's earlier rows go with it. Duplicates and
    rollups come out as if everything had been computed from all rows. more may put further tables. work is a folder for
    intermediate tables.

    * files: hash buckets by file, with the days that a file's rows are stored under and the version that parsed it.
    * records, tool_uses: by day; only days that gain, lose or change a row are written.
    * claims: one row for each stored request with an id, appended. A claim holds while its file is of the same version,
      so nothing of it is rewritten; every GENERATIONS versions those that hold become one part. Only ids of changed files
      are compared.
    * tools: counts of old rows are subtracted, those of new ones added. usage, latency: groups that a changed row is in
      are aggregated again, since first and last times and percentiles can't be subtracted.
    """
    spark, change = old.spark, versions.Change(old)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    def stored(name: str, like: DataFrame, parts: list | None = None) -> DataFrame:
        return old.read(name, parts) if name in old else spark.createDataFrame([], like.schema)

    calls = kept(tool_uses.withColumn("day", day_of("ts")), "calls")
    fresh = kept(records.drop("is_canonical").withColumn("day", day_of("ts")), "fresh")
    days = fresh.select("file_key", "day").union(calls.select("file_key", "day")).groupBy("file_key").agg(F.array_sort(F.collect_set("day")).alias("days"))
    files = files.drop("days", "generation", "bucket").join(days, "file_key", "left").withColumns({"days": F.coalesce("days", F.array().cast("array<date>")), "generation": F.lit(change.number), "bucket": _bucket()})
    files = kept(files, "files")
    changed = kept(files.select("file_key").union(gone.select("file_key")).distinct(), "changed")
    buckets = _values(changed.select(_bucket().alias("bucket")), "bucket")
    was_files = kept(stored("files", files, buckets).join(changed, "file_key", "left_semi"), "was_files")
    were = _values(was_files.select(F.explode("days").alias("day")), "day")
    was_calls = kept(stored("tool_uses", calls, were).join(changed, "file_key", "left_semi"), "was_calls")
    flagged = fresh.withColumn("is_canonical", F.lit(True))
    was = kept(stored("records", flagged, were).join(changed, "file_key", "left_semi"), "was")

    # Which of the rows that share an id counts: before and after, for ids of changed files only.
    claim = ("uuid", "file_key", "line_num", "day")
    ids = kept(was.select("uuid").union(fresh.select("uuid")).where("uuid is not null").distinct(), "ids")
    new_claims = fresh.where("uuid is not null").select(*claim)
    held = stored("claims", new_claims.withColumn("generation", F.lit(0))).join(ids, "uuid", "left_semi")
    held = kept(held.join(stored("files", files).select("file_key", "generation"), ["file_key", "generation"], "left_semi").select(*claim), "held")
    now = kept(winners(held.join(changed, "file_key", "left_anti").unionByName(new_claims)), "winners")
    flips = kept(moved(winners(held), now).join(changed, "file_key", "left_anti"), "flips")
    named = fresh.where("uuid is not null").join(now, "uuid", "left").withColumn("is_canonical", F.coalesce((F.col("one.file_key") == F.col("file_key")) & (F.col("one.line_num") == F.col("line_num")), F.lit(False))).drop("one")
    fresh = kept(named.unionByName(fresh.where("uuid is null").withColumn("is_canonical", F.lit(True))), "flagged")

    change.put("files", stored("files", files, buckets).join(changed, "file_key", "left_anti").unionByName(files, allowMissingColumns=True), "bucket", buckets, ("file_key",))
    all_files = change.now.read("files")

    touched = _values(was.select("day").union(fresh.select("day")).union(flips.select("day")), "day")
    stay = stored("records", fresh, touched).join(changed, "file_key", "left_anti").join(flips.select("file_key", "line_num", F.col("is_canonical").alias("_flag")), ["file_key", "line_num"], "left")
    turned = kept(stay.where("_flag is not null").drop("_flag"), "turned")
    stay = stay.withColumn("is_canonical", F.coalesce("_flag", "is_canonical")).drop("_flag")
    change.put("records", stay.unionByName(fresh, allowMissingColumns=True), "day", touched, ("ts",))
    here = change.now.read("records", touched)

    call_days = _values(was_calls.select("day").union(calls.select("day")), "day")
    change.put("tool_uses", stored("tool_uses", calls, call_days).join(changed, "file_key", "left_anti").unionByName(calls, allowMissingColumns=True), "day", call_days, ("ts",))

    claims = new_claims.withColumn("generation", F.lit(change.number))
    many = len(old.parts.get("claims", ())) >= GENERATIONS
    if many:
        live = old.read("claims").join(all_files.select("file_key", "generation"), ["file_key", "generation"], "left_semi")
        claims = live.unionByName(claims).repartitionByRange("uuid")
    change.put("claims", claims, order=("uuid",), add=not many)

    def regrouped(name: str, keys: tuple[str, ...], hit: DataFrame, again: Callable[[DataFrame], DataFrame], time: str) -> None:
        """The groups that a changed row is in, aggregated again from the rows of their days."""
        hit = kept(hit.select(*keys).distinct(), f"{name}_groups")
        made = again(hit).withColumn("day", day_of(time))
        days = _values(hit.select(day_of(time)), "day")
        rest = stored(name, made, days).join(hit, list(keys), "left_anti")
        change.put(name, rest.unionByName(made, allowMissingColumns=True), "day", days)

    hit = rollups.usage_rows(was, was_files).unionByName(rollups.usage_rows(fresh, files)).unionByName(rollups.usage_rows(turned.withColumn("is_canonical", F.lit(True)), all_files))
    regrouped("usage", rollups.USAGE_KEYS, hit, lambda only: rollups.usage(here, all_files, only), "hour")
    hit = rollups.latency_rows(was, was_files).unionByName(rollups.latency_rows(fresh, files))
    regrouped("latency", rollups.LATENCY_KEYS, hit, lambda only: rollups.latency(here, all_files, only=only), "bucket")

    keys, counts = rollups.TOOL_KEYS, rollups.TOOL_COUNTS
    less = rollups.tools(was_calls, was, was_files).select(*keys, *((-F.col(c)).alias(c) for c in counts))
    delta = kept(rollups.tools(calls, fresh, files).unionByName(less).withColumn("day", day_of("hour")), "tools_delta")
    hours = _values(delta, "day")
    sums = stored("tools", delta, hours).unionByName(delta).groupBy(*keys, "day").agg(*(F.sum(c).alias(c) for c in counts)).where("n_total <> 0")
    change.put("tools", sums, "day", hours)

    change.put("projects", tables.projects(old.read("projects") if "projects" in old else None, files))
    if more:
        more(change)
    return change
