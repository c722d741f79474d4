"""Keyed state of streams: the day's running number, the newest alerts of a place."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def prepare(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; set for the session unless the session has one."""
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Numbers(StatefulProcessor):
    """The last number of a day; a timer at the day's end, by the watermark, forgets it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")  # the day's rows of one micro-batch
        n = self.last.get()[0] if self.last.exists() else 0
        if n == 0:
            self.handle.registerTimer(int(pd.Timestamp(pdf["ts"].iloc[0]).normalize().value // 1_000_000) + DAY_MS)
        pdf["number"] = range(n + 1, n + 1 + len(pdf))
        self.last.update((n + len(pdf),))
        yield pdf[["event_id", "ts", "number"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "ts": pd.Series(dtype="datetime64[ns]"), "number": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def daily_numbers(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """(event_id, ts, number) of a stream (event_id long, ts timestamp): numbers from 1 each day, on from the numbers of earlier
    micro-batches, in order of time within one.  The state is a number a day; a day is forgotten when the watermark, ``late``
    behind the newest event, has passed its end, and rows later than that are dropped, so no number comes twice.  After a
    restart from the checkpoint the numbers go on."""
    prepare(events.sparkSession)
    rows = events.withWatermark("ts", late).select(F.to_date("ts").cast("string").alias("day"), "event_id", "ts")
    out = StructType([StructField("event_id", LongType()), StructField("ts", TimestampType()), StructField("number", LongType())])
    return rows.groupBy("day").transformWithStateInPandas(_Numbers(), out, "Append", "EventTime")


class _Newest(StatefulProcessor):
    """The newest alerts of a place as one list, newest first, and when each batch changed it."""

    def __init__(self, n: int, quiet_ms: int):
        self.n, self.quiet_ms = n, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("rows", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = json.loads(self.held.get()[0]) if self.held.exists() else []
        for pdf in rows:  # no more than n and a chunk at a time
            best += [[int(pd.Timestamp(t).value // 1000), int(e), m] for t, e, m in zip(pdf["ts"], pdf["event_id"], pdf["message"])]
            best = sorted(best, key=lambda r: (-r[0], -r[1]))[: self.n]
        self.held.update((json.dumps(best),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(best[0][0] // 1000 + self.quiet_ms)
        yield self._frame(key[0], best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield self._frame(key[0], [])

    @staticmethod
    def _frame(place, best) -> pd.DataFrame:
        return pd.DataFrame({"place": pd.Series([place] * len(best), dtype="object"), "rank": pd.Series(range(1, len(best) + 1), dtype="int64"), "event_id": pd.Series([r[1] for r in best], dtype="int64"), "ts": pd.to_datetime(pd.Series([r[0] for r in best], dtype="int64"), unit="us"), "message": pd.Series([r[2] for r in best], dtype="object")})

    def close(self) -> None:
        pass


def newest_alerts(alerts: DataFrame, *, n: int = 20, late: str = "1 day", quiet: int = 7) -> DataFrame:
    """(place, rank, event_id, ts, message): with each micro-batch, the n newest alerts of every place that it brought any to, from
    a stream (place string, event_id long, ts timestamp, message string); newest first, of equal times the greater id.
    A place without alerts for ``quiet`` days is forgotten."""
    prepare(alerts.sparkSession)
    rows = alerts.withWatermark("ts", late).select("place", "event_id", "ts", "message")
    out = StructType([StructField("place", StringType()), StructField("rank", LongType()), StructField("event_id", LongType()), StructField("ts", TimestampType()), StructField("message", StringType())])
    return rows.groupBy("place").transformWithStateInPandas(_Newest(n, quiet * DAY_MS), out, "Update", "EventTime")
