"""Streams: alerts as events arrive, session and tumbling windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def payload(df: DataFrame) -> DataFrame:
    """df with the alert message of each event as JSON."""
    return df.withColumn("message", F.to_json(F.struct("event_id", "severity", "risk_score", "caption_vi", "location_id", "window_start")))


def broadcast(messages: list[str], clients: dict[str, Callable[[str], None]]) -> int:
    """Send each message to every client; a client that fails is dropped.  How many deliveries succeeded."""
    sent = 0
    for m in messages:
        for name, send in list(clients.items()):
            try:
                send(m)
                sent += 1
            except Exception:  # a dead client must not stop the others
                clients.pop(name, None)
    return sent


def alert_stream(events: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None], *, least: str = "HIGH", once: bool = False):
    """Start a stream that hands each batch of severe events to deliver(batch, id); restarted, it goes on from its checkpoint."""
    order = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    severe = payload(events.where(F.col("severity").isin(order[order.index(least) :])))
    writer = severe.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return (writer.trigger(availableNow=True) if once else writer).start()


def newest(df: DataFrame, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc("window_start"), F.desc("event_id")).limit(n)


def sessions(df: DataFrame, key: list[str], ts: str = "ts", *, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, n): sessions of a key that end after a gap; ``late`` sets a watermark for streams."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *key).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(df: DataFrame, key: list[str], ts: str = "ts", *, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(ts, late) if late else df
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*key, F.col("w.start").alias("start"), "n", "total")


def replay(spark: SparkSession, folder: str, schema, **options: str) -> DataFrame:
    """Stored events as a stream."""
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.parquet(folder)
