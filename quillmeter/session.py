"""The session's settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "quillmeter", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; the cluster's own configuration decides the rest."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Puts SETTINGS on a session that someone else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
