"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur import schema
from murmur.functions.scalars import as_int16


def write_events(events: DataFrame, detections: DataFrame, folder: str, batch: int) -> None:
    """Events and their detections of one batch, each under its batch folder, which a repeated batch replaces."""
    events.withColumn("event_date", F.to_date("window_start")).sortWithinPartitions("window_start").write.mode("overwrite").partitionBy("event_date").parquet(f"{folder}/events/batch={batch}")
    detections.write.mode("overwrite").parquet(f"{folder}/detections/batch={batch}")


def with_embeddings(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Events with their vectors; an event without one is kept with null."""
    return events.drop("embedding").join(vectors.select("event_id", "embedding"), "event_id", "left")


def feedback(rows: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): rows whose event exists, and rows whose event does not."""
    ids = events.select("event_id")
    return rows.join(ids, "event_id", "left_semi"), rows.join(ids, "event_id", "left_anti")


def seed(wanted: DataFrame, present: DataFrame, key: str, path: str) -> int:
    """Append the wanted rows whose key is absent; how many there were."""
    new = wanted.join(present.select(key), key, "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def bank_csv(bank: DataFrame, path: str) -> None:
    bank.select(*schema.BANK.fieldNames()).write.mode("overwrite").csv(path, header=True)


def waveforms(df: DataFrame, path: str, samples: int) -> None:
    """Clips padded with zeros or cut to a length, as clipped 16-bit numbers."""
    cut = F.slice(F.concat("samples", F.array_repeat(F.lit(0.0), samples)), 1, samples)
    df.select("clip", F.transform(cut, lambda x: as_int16(x)).alias("samples")).write.mode("overwrite").parquet(path)


def retained(df: DataFrame, days: int, path: str) -> bool:
    """Store sounds only if they are kept for some days; whether they were."""
    if days <= 0:
        return False
    df.write.mode("append").parquet(path)
    return True


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table with decimal commas; what was not measured is said so, never 0."""
    show = lambda v: "chưa đo" if v is None else f"{v:.4f}".replace(".", ",") if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)])
