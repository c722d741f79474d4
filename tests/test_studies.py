"""Studies, replay and splits on small tables with odd rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmur.operators import metrics, provenance, runs, studies
from murmur.plans import serving


def test_error_kinds_and_segments(spark):
    rows = [
        ("c", "reference", 1, "A", 0.0, 2.0), ("c", "predicted", 11, "A", 0.1, 2.1),  # correct
        ("c", "reference", 2, "A", 10.0, 20.0), ("c", "predicted", 12, "A", 10.0, 13.0), ("c", "predicted", 13, "A", 15.0, 18.0),  # boundary, fragmented
        ("c", "reference", 3, "A", 30.0, 31.0), ("c", "predicted", 14, "B", 30.0, 31.0),  # substitution
        ("c", "reference", 4, "B", 40.0, 41.0), ("c", "predicted", 15, "B", 41.0, 42.0),  # they only touch
        ("d", "reference", 5, "A", 0.0, 1.0), ("d", "reference", 6, "A", 2.0, 3.0), ("d", "predicted", 16, "A", 0.0, 3.0),  # merge
    ]
    df = spark.createDataFrame(rows, "clip string, side string, id int, class_id string, onset double, offset double")
    for bucket in (1.0, 7.0, 100.0):
        got = {r.kind: r.n for r in studies.error_kinds(df, ["clip"], bucket=bucket).collect()}
        assert got == {"correct": 1, "boundary": 3, "substitution": 1, "deletion": 1, "insertion": 1, "fragmentation": 1, "merge": 1}
    assert studies.error_kinds(df.limit(0), ["clip"], bucket=1.0).count() == 0
    seg = {r.clip: (r.tp, r.fp, r.fn) for r in studies.segment_counts(df, ["clip"]).collect()}
    assert seg == {"c": (2 + 6 + 1, 2, 4 + 1), "d": (2, 1, 0)}


def _crowd(n, odd):
    r = random.Random(4)
    rows = []
    for i in range(n):
        at, size = r.randrange(60) / 2, r.choice([0.5, 1, 3, 12] + odd * [0, -2, None, float("nan")])
        rows.append((r.choice(["a", "b"] + odd * [None]), r.choice(["reference", "predicted"]), i, r.choice(["A", "B"] + odd * [None]), at, None if size is None else at + size))
    return rows


@pytest.mark.parametrize("odd", [0, 1])
def test_error_kinds_against_all_pairs(spark, odd):
    rows = _crowd(120, odd)
    less = lambda x, y: x is not None and y is not None and x == x and (y != y or x < y)  # noqa: E731 - NaN is greatest
    within = lambda x, y, c: x is not None and y is not None and (abs(x - y) <= c)
    met = lambda a, b: a[0] is not None and a[0] == b[0] and a[1] != b[1] and less(a[4], b[5]) and less(b[4], a[5])
    want = Counter()
    for x in rows:
        other = [y for y in rows if met(x, y)]
        same = [y for y in other if x[3] is not None and x[3] == y[3]]
        if x[1] == "predicted":
            want.update(["insertion"] * (not other) + ["merge"] * (len(same) > 1))
            continue
        hit = any(within(x[4], y[4], 1) and within(x[5], y[5], 1) for y in same)
        want.update(["deletion" if not other else "correct" if hit else "boundary" if same else "substitution"] + ["fragmentation"] * (len(same) > 1))
    df = spark.createDataFrame(rows, "clip string, side string, id int, class_id string, onset double, offset double").repartition(3)
    for bucket in (1.0, 7.0):
        assert {x.kind: x.n for x in studies.error_kinds(df, ["clip"], bucket=bucket, collar=1.0).collect()} == want


def test_kinds_and_segments_spell_nothing_out(spark):
    df = spark.createDataFrame(_crowd(40, 0), "clip string, side string, id int, class_id string, onset double, offset double")
    assert "sequence" not in studies.segment_counts(df, ["clip"])._jdf.queryExecution().toString()
    text = studies.error_kinds(df, ["clip"], bucket=1.0)._jdf.queryExecution().toString()
    assert text.count("LeftSemi") and "Inner" not in text


def test_segments_against_all_segments(spark):
    rows = [x for x in _crowd(80, 0)] + [("c", "reference", 900, "A", 2.0, None), ("d", "reference", 901, "A", None, 3.0), ("e", "predicted", 902, "A", 5.0, 5.0), ("f", "reference", 903, "A", -3.5, 9000.0), ("f", "predicted", 904, "A", 8000.0, 8500.0)]
    on = {}
    for c, side, _, _, a, b in rows:
        if a is not None:
            lo = math.floor(a)
            on.setdefault(c, {}).setdefault(side, set()).update(range(lo, max(lo, lo if b is None else math.ceil(b) - 1) + 1))
    want = {c: (len(r & p), len(p - r), len(r - p)) for c, s in on.items() for r, p in [(s.get("reference", set()), s.get("predicted", set()))]}
    df = spark.createDataFrame(rows, "clip string, side string, id int, class_id string, onset double, offset double").repartition(3)
    for bucket in (3, 4096):
        assert {x.clip: (x.tp, x.fp, x.fn) for x in studies.segment_counts(df, ["clip"], bucket=bucket).collect()} == want


def test_groups_without_rows(spark):
    gaps = spark.createDataFrame([(5.0, None), (1.0, True), (9.0, False)], "gap double, f boolean")
    got = {r.fragmented: (r.n, r.median) for r in studies.gap_summary(gaps, F.col("f"), "gap", least=F.col("gap") >= 5).collect()}
    assert got == {True: (0, None), False: (2, 7.0)}
    r = studies.long_event_ratio(spark.createDataFrame([(1, 4), (None, 4), (1, 0)], "fragmented int, n_ref int"))
    assert [x.long_ratio for x in r.collect()] == [0.25, None, None]


def test_inventories_and_sources(spark):
    b = spark.createDataFrame([("hall", 60.0, "clean"), ("hall", 60.0, "flagged"), ("road", 30.0, None)], "area_type string, duration double, verdict string")
    assert [tuple(r) for r in studies.background_by_area(b).collect()] == [("hall", 1, 1.0)]
    t = spark.createDataFrame([(1, "v"), (2, "w")], "id int, video string")
    e = spark.createDataFrame([("v",)], "video string")
    assert [r.id for r in studies.apart(t, e, "video").collect()] == [2]
    with pytest.raises(Exception, match="evaluation set is empty"):
        studies.apart(t, e.limit(0), "video").collect()
    with pytest.raises(Exception, match="class_id"):
        studies.clip_classes(t.withColumn("onset", F.lit(1.0)), ["id"]).collect()


def test_replay_and_numbers(spark):
    ev = spark.createDataFrame([("a", "/x"), ("b", ""), ("c", None)], "event_id string, audio_path string")
    assert [tuple(serving.replay(ev, i).first()) for i in "abcd"] == [("a", 200, "/x"), ("b", 410, None), ("c", 410, None), ("d", 404, None)]
    ids = spark.createDataFrame([("EVT_20240101_000003",), ("EVT_20240101_000999",), ("EVT_20240102_000001",), ("EVT_2024",), (None,)], "event_id string")
    assert {r.day: r.number for r in serving.latest_numbers(ids).collect()} == {"20240101": 999, "20240102": 1}
    assert serving.health(spark, False)["data"]["status"] == "healthy"


@pytest.mark.parametrize("n, share", [(1, 0.1), (10, 0.25), (997, 0.3), (50, 1.0)])
def test_random_split_is_exact(spark, n, share):
    got = provenance.random_split(spark.range(n), "id", share, 3)
    assert got.count() == n and got.where("validation").count() == max(1, round(n * share)) and got.columns == ["id", "validation"]
    assert provenance.random_split(spark.range(0), "id", share, 3).count() == 0


def test_cumulative_with_an_outlier(spark):
    v = [(float(i), 1) for i in range(500)] + [(1e12, 1), (-1e12, 1)]
    got = {r.v: r.cum_n for r in metrics.cumulative(spark.createDataFrame(v, "v double, n long"), "v", ["n"], []).collect()}
    assert got == {x: i + 1 for i, (x, _) in enumerate(sorted(v))}


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 1), ("c", 2)], "s string, i int")
    assert sorted(map(tuple, runs.round_robin_sample(df, F.col("s"), [F.col("i")], 6).collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 2)]
