"""A Spark session with the settings the package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "flowlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session in UTC with adaptive execution. Partition counts and memory stay with the
    cluster's own configuration; pass them as ``**{"spark.sql.shuffle.partitions": ...}``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
