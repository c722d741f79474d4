"""Listing, detail, summaries, retrieval and ingest as single plans, and the response envelope."""

from __future__ import annotations

from datetime import datetime
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import vocabulary as V
from murmur.functions.scalars import event_id, rounded, severity
from murmur.functions.text import answers, captions, document
from murmur.operators.risk import score_events
from murmur.operators.runs import daily_numbers
from murmur.operators.vectors import nearest


def filters(*, start: datetime | str | None = None, end: datetime | str | None = None, location: str | None = None, level: str | None = None, time_col: str = "window_start") -> Column:
    """The conjunction of the filters that are given; times are closed at both ends."""
    out = F.lit(True)
    for value, make in ((start, lambda v: F.col(time_col) >= F.lit(v)), (end, lambda v: F.col(time_col) <= F.lit(v)), (location, lambda v: F.col("location_id") == v), (level, lambda v: F.col("severity") == v)):
        if value is not None:
            out = out & make(value)
    return out


def page_bounds(limit: int = V.PAGE_DEFAULT, offset: int = 0) -> tuple[int, int]:
    if not 1 <= limit <= V.PAGE_MOST or offset < 0:
        raise ValueError(f"limit is 1..{V.PAGE_MOST}, offset 0 or more")
    return limit, offset


def shown_filters(given: dict[str, Any]) -> dict[str, Any]:
    """The filters of a request without the empty ones."""
    return {k: v for k, v in given.items() if v} | {"limit": V.PAGE_DEFAULT}


def listing(events: DataFrame, detections: DataFrame, locations: DataFrame, *, where: Column | None = None, class_id: str | None = None, limit: int = V.PAGE_DEFAULT, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): events newest first with their place and number of detections, and the count under the same filters.
    The page is cut before detections and places are joined to it."""
    limit, offset = page_bounds(limit, offset)
    rows = events if where is None else events.where(where)
    if class_id is not None:
        rows = rows.join(detections.where(F.col("class_id") == class_id).select("event_id"), "event_id", "left_semi")
    page = rows.orderBy(F.desc("window_start"), "event_id").offset(offset).limit(limit)
    n = detections.join(F.broadcast(page.select("event_id")), "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("n"))  # a page has PAGE_MOST rows at most
    out = page.join(n, "event_id", "left").join(locations.select("location_id", F.col("name").alias("location")), "location_id", "left").withColumn("n_detections", F.coalesce("n", F.lit(0))).drop("n")
    return out.orderBy(F.desc("window_start"), "event_id"), rows.agg(F.count("*").alias("total"))


def detail(events: DataFrame, detections: DataFrame, id_: str) -> DataFrame:
    """An event with its detections by onset and whether it has sound; no row if there is no such event."""
    one = events.where(F.col("event_id") == id_).limit(1)
    d = detections.where(F.col("event_id") == id_).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("onset", "ord", "offset", "class_id", "confidence"))).alias("detections"))
    return one.join(d, "event_id", "left").withColumn("has_audio", F.coalesce(F.col("audio_path") != "", F.lit(False)))


def summary(events: DataFrame, detections: DataFrame, feedback: DataFrame) -> dict[str, DataFrame]:
    """Counts by severity, counts by class (most first), and the false alarm rate, null without feedback; feedback that was
    not judged counts in the denominator."""
    rate = F.when(F.col("n") > 0, rounded(1 - F.col("t") / F.col("n"), 4))
    return {
        "severity": events.groupBy("severity").agg(F.count("*").alias("n")),
        "class": detections.groupBy("class_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class_id"),
        "false_alarms": feedback.agg(F.count("*").alias("n"), F.count_if("is_true_alarm").alias("t")).select(rate.alias("false_alarm_rate")),
    }


def model_status(metrics: DataFrame) -> DataFrame:
    """The latest row of model versions."""
    return metrics.orderBy(F.desc("created_at")).limit(1)


class AnswerProvider(Protocol):
    name: str

    def answer(self, found: DataFrame, questions: DataFrame) -> DataFrame: ...


class Listed:
    """Answers that quote the stored captions and add nothing."""

    name = "template"

    def answer(self, found: DataFrame, questions: DataFrame) -> DataFrame:
        return answers(found, questions)


def provider(name: str) -> AnswerProvider:
    known = {p.name: p for p in (Listed(),)}
    if name not in known:
        raise ValueError(f"no answer provider {name!r}; there are {sorted(known)}")
    return known[name]


def ask(events: DataFrame, query: list[float], *, question_id: int = 1, where: Column | None = None, k: int = V.TOP_K, min_similarity: float = V.MIN_SIMILARITY, by: str = "template") -> tuple[DataFrame, DataFrame]:
    """(answer, citations) to a question given by its vector."""
    found = nearest(events, query, k=k, min_similarity=min_similarity, where=where).withColumn("question_id", F.lit(question_id))
    questions = events.sparkSession.range(1).select(F.lit(question_id).alias("question_id"))
    cites = found.select("event_id", "window_start", "caption_vi", "severity", rounded("similarity", 4).alias("similarity"))
    return provider(by).answer(found, questions), cites


def ingest(windows: DataFrame, detections: DataFrame, tiers: DataFrame, locations: DataFrame, *, latest: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, detections) of uploaded windows (window_key, window_start, duration, location_id, audio_path): risk, captions,
    ids numbered by day after the latest number of that day (yyyyMMdd), and the text for retrieval.  Windows without
    detections stay, as quiet events."""
    risk = score_events(detections, tiers, key=["window_key"])
    items = detections.groupBy("window_key").agg(F.array_sort(F.collect_list(F.struct("ord", "class_id", "onset", "offset", "confidence"))).alias("detections"))
    df = windows.join(risk, "window_key", "left").join(items, "window_key", "left").join(locations.select("location_id", F.col("name").alias("location"), "area_type"), "location_id", "left")
    df = df.withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0))).withColumn("severity", F.coalesce("severity", severity(F.lit(0.0)))).withColumn("window_end", F.expr("timestampadd(MICROSECOND, CAST(duration * 1000000 AS BIGINT), window_start)"))
    df = captions(df).withColumn("class_ids", F.coalesce(F.array_distinct("detections.class_id"), F.array().cast("array<string>")))
    past = F.coalesce(F.create_map(*[F.lit(x) for kv in (latest or {"": 0}).items() for x in kv])[F.date_format("window_start", "yyyyMMdd")], F.lit(0))
    df = daily_numbers(df, "window_start", "window_key").withColumn("event_id", event_id("window_start", (F.col("number") + past).cast("int"))).withColumn("document", document())
    children = df.select("event_id", F.explode("detections").alias("d")).select("event_id", "d.*")
    return df.drop("detections", "number"), children


def ok(data: Any, **meta: Any) -> dict:
    return {"success": True, "data": data, "error": None, "meta": meta or None}


def fail(code: str, message: str, **meta: Any) -> dict:
    return {"success": False, "data": None, "error": {"code": code, "message": message}, "meta": meta or None}


def replay(events: DataFrame, id_: str) -> DataFrame:
    """(event_id, status, audio_path): 200 with the path, 404 where there is no such event, 410 where it has no sound.
    Whether the file is still there is for whoever opens it."""
    asked = events.sparkSession.range(1).select(F.lit(id_).alias("event_id"))
    one = events.where(F.col("event_id") == id_).select(F.lit(True).alias("_found"), F.nullif("audio_path", F.lit("")).alias("audio_path")).limit(1)
    status = F.when(F.col("_found").isNull(), 404).when(F.col("audio_path").isNull(), 410).otherwise(200)
    return asked.join(one, F.lit(True), "left").select("event_id", status.alias("status"), "audio_path")  # one row each


def places(locations: DataFrame) -> DataFrame:
    """All locations in the order of their ids."""
    return locations.orderBy("location_id")


def latest_numbers(events: DataFrame) -> DataFrame:
    """(day, number): the greatest number in the event ids of each day (yyyyMMdd), by which ingest goes on; ids of another
    form take no part."""
    ids = events.where(F.col("event_id").rlike("^EVT_[0-9]{8}_[0-9]{6}$"))
    return ids.groupBy(F.substring("event_id", 5, 8).alias("day")).agg(F.max(F.substring("event_id", 14, 6).cast("int")).alias("number"))


def health(spark, inference: bool) -> dict:
    """Healthy if the engine answers, degraded if not; whether models answer is shown and decides nothing."""
    try:
        spark.range(1).count()
        engine = "ok"
    except Exception as e:  # noqa: BLE001 - any failure is what this reports
        engine = f"error: {type(e).__name__}"
    return ok({"status": "healthy" if engine == "ok" else "degraded", "checks": {"database": engine, "inference": "ok" if inference else "not ready"}})
