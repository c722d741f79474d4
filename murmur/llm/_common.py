"""What the operators share: reading tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is named and Spark is local, as
    a folder of the driver's is of no use to executors elsewhere."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="murmur-")
    spark.sparkContext.setCheckpointDir(_own_dir)
    return f"file://{_own_dir}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str):
    """The column as a string, null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df does not use, in any letter case."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def once(df: DataFrame, **exprs) -> DataFrame:
    """df with the given columns, each computed once a row: the optimiser neither copies the expressions
    into later ones nor moves filters below them, as it does with plain projections."""
    (tmp,) = spare(df, "once_")
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in exprs}]
    df = df.select("*", F.explode(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))).alias(tmp))
    return df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{tmp}.{n}") for n in exprs])


_shipped: set[str] = set()
#: Bytes of an Arrow batch, of 10,000 long texts otherwise: Spark and the Python worker each hold one or two a task.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless PYTHONPATH already leads their workers to it; and bound the bytes of
    Arrow batches, for the session, unless it has a setting of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp()) / "murmur.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "murmur").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it waits for a collection otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
