"""Running sums along an order in two levels, by buckets of each key, so that a key is spread over as many tasks as it has
buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, key: list[str], order: list[str], bucket: Column, sums: dict[str, Column], peaks: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """df with, for each name of sums, the sum of its expression over the rows before in the key's order, ``<name>_all``, that
    over the whole key, for each name of peaks the greatest value in the key, and for each of tops that of the rows before (null
    for the first); ``_b`` is the row's bucket.

    ``bucket`` does not decrease along the order.  Sums of buckets come first and are added up along the key, a row a bucket;
    each bucket then gets one row that holds what comes before it, sorted before its own rows, so rows are shuffled once and
    joined with nothing.  Rows that tie in the order come in any sequence.  Null keys are a key, null buckets the first one.
    """
    peaks, tops = peaks or {}, tops or {}
    rows = df.withColumn("_b", bucket).withColumns({f"_v{n}": e for n, e in {**sums, **peaks, **tops}.items()}).withColumn("_own", F.lit(True))
    parts = rows.groupBy(*key, "_b").agg(*[F.sum(f"_v{n}").alias(f"_v{n}") for n in sums], *[F.max(f"_v{n}").alias(f"_v{n}") for n in [*peaks, *tops]])
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    held = [F.coalesce(F.sum(f"_v{n}").over(before), F.lit(0).cast(parts.schema[f"_v{n}"].dataType)).alias(f"_v{n}") for n in sums]
    held += [F.sum(f"_v{n}").over(whole).alias(f"_a{n}") for n in sums] + [F.max(f"_v{n}").over(whole).alias(f"_a{n}") for n in peaks]
    held += [F.max(f"_v{n}").over(before).alias(f"_v{n}") for n in tops]
    heads = parts.select(*key, "_b", *held, F.lit(False).alias("_own"))
    inner = Window.partitionBy(*key, "_b").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.unionByName(heads, allowMissingColumns=True)
    made = [F.sum(f"_v{n}").over(inner).alias(n) for n in sums] + [F.first(f"_a{n}").over(inner).alias(f"{n}_all") for n in sums]
    made += [F.first(f"_a{n}").over(inner).alias(n) for n in peaks] + [F.max(f"_v{n}").over(inner).alias(n) for n in tops]
    return out.select(*df.columns, "_b", "_own", *made).where("_own").drop("_own")
