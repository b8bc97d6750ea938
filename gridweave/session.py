"""The session that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **options: str) -> SparkSession:
    """UTC, adaptive execution, and point codes that stay strings when they come from paths."""
    builder = SparkSession.builder.appName("gridweave")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    }
    for key, value in (settings | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
