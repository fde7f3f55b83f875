"""Spark session with the settings the engine is meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tagweave", master: str | None = None, **conf: str) -> SparkSession:
    """AQE with coalescing and skew joins; the number of shuffle partitions is left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
