"""The Spark session that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "murmur", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments add settings, with _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
