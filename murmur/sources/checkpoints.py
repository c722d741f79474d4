"""Intermediate tables in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the folder set on the context; a folder of our own only where neither is set and Spark is local,
    as a folder of the driver's is of no use to executors elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='murmur-')}"
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a table of its own in that folder and read back: its plan ends there, and a lost executor costs no more
    than the tasks it ran."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
