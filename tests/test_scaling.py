"""Operators that deal a key over tasks, against brute force: running sums, runs, filters, percentiles, matching."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import metrics, runs
from murmur.operators.matching import matched
from murmur.operators.order import running
from murmur.operators.quantiles import percentiles


def test_running_sums_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "b", None]), i, r.randrange(9), r.choice([0.5, 2.0, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int, x double").repartition(5)
    got = running(df, ["k"], ["t"], F.floor(F.col("t") / 16), {"n": F.lit(1), "s": F.col("v")}, {"top": F.col("x")}).collect()
    assert len(got) == 400 and got[0].__fields__ == ["k", "t", "v", "x", "_b", "n", "s", "n_all", "s_all", "top"]
    for x in got:
        mine = [y for y in rows if y[0] == x.k]
        before = [y for y in mine if y[1] < x.t]
        assert (x.n, x.s) == (len(before), sum(y[2] for y in before)) and (x.n_all, x.s_all) == (len(mine), sum(y[2] for y in mine))
        assert x.top == max(y[3] for y in mine if y[3] is not None)


def best(flags):
    out, i = None, 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j > i and (out is None or j - i > out[1] - out[0]):
            out = (i, j)
        i = max(j, i + 1)
    return out


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9, 1.0, 0.0])
def test_longest_runs_cross_buckets(spark, share):
    r = random.Random(int(share * 10))
    flags = {k: [r.random() < share for _ in range(n)] for k, n in (("a", 200), ("b", 33), ("c", 1))}
    rows = [(k, i, f if f or r.random() < 0.5 else None) for k, fs in flags.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "k string, t int, f boolean").repartition(3)
    want = {k: best(fs) for k, fs in flags.items() if any(fs)}
    for width in (1, 7, 1000):
        got = runs.longest_run(df, ["k"], ["t"], F.col("f"), F.floor(F.col("t") / width)).collect()
        assert {x.k: (x.start, x.end) for x in got} == want


def test_boundaries_of_a_clip_longer_than_a_bucket(spark):
    n = 3 * runs.BUCKET
    rows = [("c", i, 0.8 if 1000 <= i < 2100 or i < 900 else 0.1) for i in range(n)] + [("z", i, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "clip string, frame int, prob double").withColumn("duration", F.lit(n / 100.0))
    got = {x.clip: (x.onset, x.offset, x.peak) for x in runs.boundaries(df, ["clip"]).collect()}
    assert got == {"c": (9.95, 21.05, 0.8), "z": (0.0, n / 100.0, 0.0)}


def test_no_task_gets_more_than_a_bucket_of_one_user(spark):
    e = spark.range(20000).select(F.lit(1).alias("u"), F.col("id").alias("t"), (F.col("id") % 7 > 0).alias("f"))
    placed = running(e, ["u"], ["t"], F.floor(F.col("t") / 500), {"_p": F.lit(1)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [x.n for x in placed.groupBy(F.spark_partition_id().alias("p"), "_b").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) == 500
    assert runs.longest_run(e, ["u"], ["t"], F.col("f"), F.floor(F.col("t") / 500)).collect()[0].asDict() == {"u": 1, "start": 1, "end": 7}


def test_days_are_numbered_in_order_over_minutes(spark):
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=r.randrange(3 * 86400), microseconds=r.choice([0, 5]))) for i in range(500)] + [(900 + i, t0) for i in range(30)]
    got = runs.daily_numbers(spark.createDataFrame(rows, "id int, ts timestamp_ntz").repartition(4), "ts", "id").collect()
    want = {}
    for day in {t.date() for _, t in rows}:
        for n, (i, _) in enumerate(sorted((x for x in rows if x[1].date() == day), key=lambda x: (x[1], x[0])), 1):
            want[i] = n
    assert {x.id: x.number for x in got} == want and got[0].__fields__ == ["id", "ts", "number"]


def test_median_filter_by_class_width(spark):
    r = random.Random(4)
    sizes = {"short": (1, 40), "mid": (7, 2100), "long": (51, 1100)}
    rows = [(k, i, w, r.random()) for k, (w, n) in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "class_id string, frame int, width int, v double").repartition(3)
    got = runs.median_filter_by(df, ["class_id"], ["frame"], "v", "width", F.floor(F.col("frame") / 300)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["class_id", "frame", "width", "v", "median"]
    by = {k: [x[3] for x in rows if x[0] == k] for k in sizes}
    for x in got:
        vs, h = by[x.class_id], x.width // 2
        near = sorted(vs[max(0, x.frame - h) : x.frame + h + 1])
        assert x.median == near[len(near) // 2]
    bad = df.where("class_id = 'short'").withColumn("width", F.lit(8))
    with pytest.raises(Exception, match="odd"):
        runs.median_filter_by(bad, ["class_id"], ["frame"], "v", "width", F.lit(0)).collect()


def test_widths_come_from_the_short_events_of_a_class(spark):
    rows = [("a", 0.07), ("a", 0.08), ("a", 5.0), ("b", 9.0), ("c", 0.001), ("a", 4.0), ("a", 3.0)]
    got = runs.widths(spark.createDataFrame(rows, "class_id string, length double"), "class_id", "length", step=0.01).collect()
    assert {x.class_id: x.width for x in got} == {"a": 7, "b": 51, "c": 1}


@pytest.mark.parametrize("few", [4, 4096])
def test_percentiles_equal_numpy(spark, few):
    r = random.Random(few)
    data = {"normal": [r.gauss(0, 1) for _ in range(3000)], "ties": [float(r.choice([1, 1, 1, 2, 7])) for _ in range(2500)], "wild": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(2000)], "one": [4.0], "two": [1.0, 2.0], None: [5.0, 9.0, 1.0], "same": [3.0] * 999}
    data["mass"] = [float(i) for i in range(700)] + [350.5] * 3000
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("normal", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(x.k, x.share): x.value for x in percentiles(df, "v", shares, ["k"], few=few).collect()}
    assert len(got) == len(data) * len(shares)
    for k, vs in data.items():
        for s in shares:
            assert got[k, s] == pytest.approx(np.quantile(vs, s), rel=1e-9), (k, s)
    every = [v for vs in data.values() for v in vs]
    assert [x.value for x in percentiles(df, "v", [0.25], few=few).collect()] == pytest.approx([np.quantile(every, 0.25)])
    assert percentiles(df.where("false"), "v", [0.5], ["k"]).count() == 0


def pairs(rows, collar):
    out = {}
    for k in {x[0] for x in rows}:
        side = {s: [(x[2], 0.0) for x in rows if x[0] == k and x[1] == s] for s in ("reference", "predicted")}
        for i, j in metrics.greedy_pairs(side["reference"], side["predicted"], collar):
            p = (k, side["reference"][i][0], side["predicted"][j][0])
            out[p] = out.get(p, 0) + 1
    return out


@pytest.mark.parametrize("seed,grid,collar", [(1, 1.0, 3.0), (2, 0.25, 0.5), (3, 0.1, 0.2), (4, 0.0, 0.3), (5, 1.0, 0.0)])
def test_matching_equals_the_greedy_rule(spark, seed, grid, collar):
    r = random.Random(seed)
    at = lambda n: r.uniform(0, n) if not grid else grid * r.randrange(int(n / grid))
    rows = [(k, r.choice(["reference", "predicted"]), at(n)) for k, n in (("a", 8), ("b", 30), ("c", 300), (None, 5)) for _ in range(60)]
    df = spark.createDataFrame([*rows, ("a", "predicted", None), ("only", "reference", 1.0)], "k string, side string, onset double").repartition(3)
    got = {(x.k, x.reference, x.predicted): x.n for x in matched(df, ["k"], collar=collar, stretch=2).collect()}
    assert got == pairs(rows, collar)
    counts = {x.k: x for x in metrics.event_counts(df.withColumn("offset", F.lit(0.0)), key=["k"], collar=collar).collect()}
    for k in ("a", "b", "c", None):
        mine = {p: n for p, n in got.items() if p[0] == k}
        assert counts[k].tp == sum(mine.values()) and counts[k].shift == pytest.approx(sum(abs(a - b) * n for (_, a, b), n in mine.items()))
    assert (counts["only"].tp, counts["only"].fn, counts["only"].fp, counts["only"].shift) == (0, 1, 0, 0.0)
    assert counts["a"].fp + counts["a"].tp == sum(x[0] == "a" and x[1] == "predicted" for x in rows) + 1


def test_a_busy_group_of_events_ends(spark):
    e = spark.range(100_000).select(F.lit("c").alias("k"), F.when(F.col("id") % 2 == 0, "reference").otherwise("predicted").alias("side"), (F.floor(F.pmod(F.xxhash64("id"), F.lit(1_000_000))) / 100.0).alias("onset"))
    began = time.time()
    n = matched(e, ["k"], collar=0.2).agg(F.sum("n")).first()[0]
    assert 30_000 < n <= 50_000 and time.time() - began < 120


@pytest.mark.parametrize("few", [0, 10**6])
def test_cumulative_sums_of_groups(spark, few):
    r = random.Random(9)
    rows = [(g, float(v), r.randrange(5)) for g in ("a", "b") for v in {round(r.expovariate(0.1), 2) for _ in range(400)}]
    got = metrics.cumulative(spark.createDataFrame(rows, "g string, v double, n long").repartition(3), "v", ["n"], ["g"], few=few).collect()
    assert len(got) == len(rows)
    for x in got:
        mine = [y for y in rows if y[0] == x.g]
        assert (x.cum_n, x.all_n) == (sum(y[2] for y in mine if y[1] <= x.v), sum(y[2] for y in mine))
