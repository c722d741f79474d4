"""Interval algebra on (key, start, end) in whole units, such as microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.scalars import ratio


def merged(df: DataFrame, key: list[str], start: str = "start", end: str = "end", *, bucket: int | None = None) -> DataFrame:
    """(key, start, end): the islands that the intervals of each key cover; touching ones join, empty ones go.

    bucket, in units of start, merges within stretches of time first, so that a key with very many intervals is
    reduced by many tasks before its islands meet in one.
    """
    rows = df.select(*key, F.col(start).alias("start"), F.col(end).alias("end")).where("end > start")
    if bucket:
        rows = rows.withColumn("_b", F.floor(F.col("start") / bucket))
        rows = _islands(rows, [*key, "_b"]).drop("_b")
    return _islands(rows, key)


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0))
    return opened.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def coverage(df: DataFrame, key: list[str], start: str = "start", end: str = "end", *, bucket: int | None = None) -> DataFrame:
    """A row a key: n, covered (length of the union), total (sum of lengths), span (first start to last end),
    coverage = covered / span and compression = covered / total, null where there is nothing to divide by."""
    islands = merged(df, key, start, end, bucket=bucket).groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    all_ = df.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.col(end) - F.col(start))).alias("total"), (F.max(end) - F.min(start)).alias("span"))
    out = all_.join(islands, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return out.select(*key, "n", "covered", "total", "span", ratio("covered", "span").alias("coverage"), ratio("covered", "total").alias("compression"))


def overlap_join(a: DataFrame, b: DataFrame, key: list[str], *, width: int, how: str = "inner", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of a and b with equal keys whose intervals overlap strictly: a.start < b.end and b.start < a.end.

    Intervals are dealt to time buckets of the given width, so a key's rows are compared within buckets only; a pair is
    kept in the bucket of its later start and so appears once.  Columns of b come as b_<name>.  how is inner or left.
    """
    def dealt(df: DataFrame, name: str) -> DataFrame:
        lo, hi = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
        return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))

    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    rb = right.withColumnRenamed(f"b_{start}", start).withColumnRenamed(f"b_{end}", end)
    rb = dealt(rb, "_bb").withColumnRenamed(start, f"b_{start}").withColumnRenamed(end, f"b_{end}")
    left = a.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else a
    la = dealt(left, "_ba")
    on = [la[k] == rb[f"b_{k}"] for k in key] + [la["_ba"] == rb["_bb"], la[start] < rb[f"b_{end}"], rb[f"b_{start}"] < la[end], la["_ba"] == F.floor(F.greatest(la[start], rb[f"b_{start}"]) / width)]
    pairs = la.join(rb, on).drop("_ba", "_bb")
    if how != "left":
        return pairs
    found = pairs.select("_row", *[c for c in pairs.columns if c.startswith("b_")])
    return left.join(found, "_row", "left").drop("_row")


def fragmentation(reference: DataFrame, predicted: DataFrame, key: list[str], *, id_col: str, width: int) -> DataFrame:
    """(id_col, key, n_matches, fragmented) for each reference interval: it is fragmented if two or more predictions of
    its key overlap it.  id_col names a reference interval."""
    hits = overlap_join(reference, predicted, key, width=width).groupBy(id_col).agg(F.count("*").alias("n"))
    return reference.select(id_col, *key).join(hits, id_col, "left").select(id_col, *key, F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), (F.coalesce("n", F.lit(0)) >= 2).alias("fragmented"))


def gaps(df: DataFrame, key: list[str], start: str = "start", end: str = "end", *, bucket: int | None = None) -> DataFrame:
    """(key, gap_start, gap_end): the free stretches between the islands of each key."""
    w = Window.partitionBy(*key).orderBy("start")
    return merged(df, key, start, end, bucket=bucket).select(*key, F.col("end").alias("gap_start"), F.lead("start").over(w).alias("gap_end")).where("gap_end IS NOT NULL")
