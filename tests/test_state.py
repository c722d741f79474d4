"""Streams with keyed state against the batch results: replays in micro-batches, restarts, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from murmur.operators import runs
from murmur.streaming import state

T0 = dt.datetime(2024, 1, 1)


def stored(spark, folder, parts):
    """A file a micro-batch, in the order of their names and times."""
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{folder}/tmp{i}")
    import os
    import shutil
    import time

    os.makedirs(f"{folder}/in", exist_ok=True)
    for i in range(len(parts)):
        (f,) = [x for x in os.listdir(f"{folder}/tmp{i}") if x.endswith(".parquet")]
        shutil.copy(f"{folder}/tmp{i}/{f}", f"{folder}/in/{i:03}.parquet")
        now = time.time() - 1000 + 10 * i
        os.utime(f"{folder}/in/{i:03}.parquet", (now, now))
    return parts[0].schema


def run(spark, folder, schema, transform, mode, batches=None):
    """Replays the files one at a time; what each micro-batch gave."""
    got = {}

    def keep(df, i):
        got[i] = df.collect()
        if batches is not None and len(got) >= batches:
            raise RuntimeError("executor lost")

    q = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).writeStream.option("checkpointLocation", f"{folder}/cp").outputMode(mode).foreachBatch(keep).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception as e:
        assert batches is not None and "executor lost" in str(e)
    return got


def thirds(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("place"), F.col("event_type").alias("message"))
    rows = sorted(e.collect(), key=lambda r: (r.ts, r.event_id))
    n = len(rows) // 3 + 1
    return [spark.createDataFrame(rows[i : i + n], e.schema) for i in range(0, len(rows), n)]


def test_numbers_of_a_replay_are_those_of_the_batch(spark, tmp_path):
    parts = thirds(spark)
    schema = stored(spark, tmp_path, parts)
    one = run(spark, tmp_path, schema, state.daily_numbers, "append", batches=1)  # fails after its first micro-batch
    two = run(spark, tmp_path, schema, state.daily_numbers, "append")
    assert min(two) <= max(one) + 1
    every = {r.event_id: r.number for i in sorted({**one, **two}) for r in {**one, **two}[i]}
    whole = parts[0].union(parts[1]).union(parts[2])
    want = {r.event_id: r.number for r in runs.daily_numbers(whole.select("event_id", "ts"), "ts", "event_id").collect()}
    assert every == want and len(want) == 1000


def test_late_rows_of_a_forgotten_day_repeat_no_number(spark, tmp_path):
    at = lambda *hours: spark.createDataFrame([(int(h), T0 + dt.timedelta(hours=h)) for h in hours], "event_id long, ts timestamp")
    schema = stored(spark, tmp_path, [at(1, 2), at(100), at(200), at(3, 201)])
    got = run(spark, tmp_path, schema, state.daily_numbers, "append")
    numbers = [(r.event_id, r.number) for i in sorted(got) for r in got[i]]
    assert numbers == [(1, 1), (2, 2), (100, 1), (200, 1), (201, 2)]


def test_newest_alerts_of_a_replay_are_those_of_the_batch(spark, tmp_path):
    parts = thirds(spark)
    schema = stored(spark, tmp_path, parts)
    got = run(spark, tmp_path, schema, lambda s: state.newest_alerts(s, n=3, quiet=400), "update")
    now = {}
    for i in sorted(got):
        for p in {r.place for r in got[i]}:
            now[p] = [(r.rank, r.event_id, r.message) for r in sorted((r for r in got[i] if r.place == p), key=lambda r: r.rank)]
    want = {}
    for r in sorted((r for p in parts for r in p.collect()), key=lambda r: (r.ts, r.event_id), reverse=True):
        mine = want.setdefault(r.place, [])
        if len(mine) < 3:
            mine.append((len(mine) + 1, r.event_id, r.message))
    assert now == want
