"""Contracts of the operators on small hand-made inputs."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.functions import scalars as S
from murmur.functions import text as X
from murmur.functions import vocabulary as V
from murmur.operators import graph, intervals, metrics, provenance, runs, signal, vectors
from murmur.operators.risk import score_events

TIERS = {"gunshot": "Critical", "scream": "High", "door_slam": "Medium", "fireworks": "Negative"}


def risk(spark, rows):
    d = spark.createDataFrame([("e", i, c, 0.0, 1.0, p) for i, (c, p) in enumerate(rows)], "event_id string, ord int, class_id string, onset double, offset double, confidence double")
    return score_events(d, V.tiers(spark, TIERS), key=["event_id"]).first()


@pytest.mark.parametrize("p,level", [(0.349, "LOW"), (0.35, "MEDIUM"), (0.599, "MEDIUM"), (0.60, "HIGH"), (0.799, "HIGH"), (0.80, "CRITICAL")])
def test_severity_bounds(spark, p, level):
    assert spark.range(1).select(S.severity(F.lit(p))).first()[0] == level


def test_risk_floor_unknown_and_guard(spark):
    r = risk(spark, [("gunshot", 0.10), ("scream", 0.09), ("whale", 0.9)])
    assert (r.risk_score, r.severity, r.guards, r.n_usable) == (0.1, "LOW", ["confidence_floor"], 1)
    assert risk(spark, [("fireworks", 0.95), ("gunshot", 0.59)]).guards == ["group_b_block"]
    assert risk(spark, [("fireworks", 0.95), ("gunshot", 0.60)]).severity == "HIGH"
    assert risk(spark, [("whale", 0.9)]).risk_score == 0.0
    # the first of equal confidences is the dominant one
    assert risk(spark, [("scream", 0.5), ("fireworks", 0.5)]).dominant_class == "scream"


def test_risk_grows_with_confidence(spark):
    assert risk(spark, [("scream", 0.5)]).risk_score <= risk(spark, [("scream", 0.6)]).risk_score


def spans(spark, rows):
    return spark.createDataFrame([(k, i, a, z) for i, (k, a, z) in enumerate(rows)], "k string, id int, start long, end long")


def test_union_and_gaps(spark):
    rows = [("a", 0, 10), ("a", 5, 15), ("a", 5, 15), ("a", 20, 30), ("a", 30, 31), ("a", 7, 7), ("b", 4, 4)]
    for bucket in (None, 6):
        got = intervals.merged(spans(spark, rows), ["k"], bucket=bucket).collect()
        assert sorted((r.start, r.end) for r in got) == [(0, 15), (20, 31)]
    assert [(r.gap_start, r.gap_end) for r in intervals.gaps(spans(spark, rows), ["k"]).collect()] == [(15, 20)]
    c = {r.k: r for r in intervals.coverage(spans(spark, rows), ["k"]).collect()}
    assert c["a"].covered == 26 and c["b"].covered == 0 and c["b"].coverage is None


def test_union_at_most_the_sum(spark):
    r = random.Random(3)
    rows = [("a", a := r.randrange(1000), a + r.randrange(1, 60)) for _ in range(200)]
    c = intervals.coverage(spans(spark, rows), ["k"]).first()
    more = intervals.coverage(spans(spark, rows + rows[:1]), ["k"]).first()
    assert c.covered <= c.total and more.covered == c.covered
    assert c.covered == len({x for _, a, z in rows for x in range(a, z)})


def test_overlap_join_is_strict_and_complete(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), a := r.randrange(300), a + r.randrange(0, 40)) for _ in range(120)]
    df = spans(spark, rows)
    got = sorted((x.id, x.b_id) for x in intervals.overlap_join(df, df, ["k"], width=16).collect())
    want = sorted((i, j) for i, (k, a, z) in enumerate(rows) for j, (m, b, y) in enumerate(rows) if k == m and a < y and b < z)
    assert got == want
    left = intervals.overlap_join(df, df.where("id < 0"), ["k"], width=16, how="left")
    assert left.count() == len(rows) and left.where("b_id IS NOT NULL").count() == 0


def test_fragmentation_unmeasured_is_null(spark):
    df = spans(spark, [("a", 0, 10), ("a", 1, 3), ("a", 5, 8), ("b", 0, 5)])
    got = {r.id: r.fragmented for r in intervals.fragmentation(df.where("id IN (0, 3)"), df.where("id IN (1, 2)"), ["k"], id_col="id", width=4).collect()}
    assert got == {0: True, 3: False}
    assert spark.range(1).select(S.ratio(F.lit(1), F.lit(0))).first()[0] is None


def test_longest_run_first_of_equals(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 0])] + [("b", 0, 0)], "k string, i int, f int")
    assert [tuple(r) for r in runs.longest_run(df, ["k"], ["i"], F.col("f") == 1).collect()] == [("a", 0, 2)]


def test_boundaries(spark):
    probs = [0.0, 0.1, 0.2, 0.2, 0.05, 0.2]
    df = spark.createDataFrame([("a", i, p, 6.0) for i, p in enumerate(probs)] + [("z", i, 0.0, 6.0) for i in range(3)], "clip string, frame int, prob double, duration double")
    got = {r.clip: (r.onset, r.offset) for r in runs.boundaries(df, ["clip"]).collect()}
    assert got == {"a": (0.95, 4.05), "z": (0.0, 6.0)}


def test_detections_from_frames(spark):
    rows = [("c", f, code, p, 2.0) for f, ps in enumerate([(0.1, 0.3, 0.19), (0.6, 0.2, 0.1)]) for code, p in enumerate(ps)]
    frames = spark.createDataFrame(rows, "clip string, frame int, code int, prob double, duration double")
    codes = spark.createDataFrame([("siren", 0), ("siren", 1), ("laughter", 2)], "class_id string, code int")
    got = runs.detections(frames, codes).collect()
    assert [(r.class_id, r.ord, r.confidence) for r in got] == [("siren", 0, 0.6)]


def test_median_filter_and_rebuild(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([9, 1, 1, 9, 1])], "k string, i int, v double")
    assert [r.median for r in runs.median_filter(df, ["k"], ["i"], "v", 3).orderBy("i").collect()] == [9.0, 1.0, 1.0, 1.0, 9.0]
    with pytest.raises(ValueError):
        runs.median_filter(df, ["k"], ["i"], "v", 4)
    seg = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2)], "k string, seg int, prob double")
    assert [r.value for r in runs.rebuild_frames(seg, ["k"], per_segment=2, n_frames=5).orderBy("frame").collect()] == [0.1, 0.1, 0.2, 0.2, 0.2]
    with pytest.raises(Exception, match="more segments"):
        runs.rebuild_frames(seg, ["k"], per_segment=2, n_frames=2).collect()


def test_frames_touch_one_at_least(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5), ("a", 9.99, 12.0)], "clip string, onset double, offset double")
    assert sorted(r.frame for r in runs.expand_frames(df, ["clip"], n_frames=10, duration=10.0).collect()) == [0, 9]


def test_chain(spark):
    steps, pauses = V.CHAINS["break_in"]
    rows = [("a", 0, "glass_breaking", 0.0, 1.0), ("a", 1, "scream", 1.5, 2.0), ("a", 2, "running_footsteps", 2.5, 4.0), ("b", 0, "glass_breaking", 0.0, 1.0), ("b", 1, "scream", 1.1, 2.0), ("b", 2, "running_footsteps", 2.5, 4.0)]
    df = spark.createDataFrame(rows, "clip string, ord int, class_id string, onset double, offset double")
    assert [(r.clip, r.first, r.last) for r in runs.chains(df, ["clip"], steps, pauses).collect()] == [("a", 0, 2)]


def test_event_ids(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    day = F.lit(dt.datetime(2026, 9, 17, 1))
    assert one(S.event_id(day, F.lit(124))) == "EVT_20260917_000124"
    assert one(S.event_number(F.lit("EVT_20260917_000999"), F.lit("20260917"))) == 999
    for bad in (0, 1_000_000):
        with pytest.raises(Exception, match="out of range"):
            one(S.event_id(day, F.lit(bad)))
    with pytest.raises(Exception, match="bad event id"):
        one(S.event_number(F.lit("EVT_20260916_000001"), F.lit("20260917")))


def test_captions(spark):
    cases = [
        (None, V.NO_EVENT_EN, V.NO_EVENT_VI),
        ([("scream", 0.0, 1.0)], "A person screaming is heard.", "Nghe thấy tiếng hét hoảng loạn."),
        ([("siren", 2.0, 3.0), ("scream", 0.0, 1.0)], "A person screaming is followed by a siren.", "Nghe thấy tiếng hét hoảng loạn, sau đó là tiếng còi hú."),
        ([("scream", 0.0, 3.0), ("siren", 2.0, 3.0)], "A person screaming and a siren are heard at the same time.", "Nghe thấy tiếng hét hoảng loạn và tiếng còi hú cùng lúc."),
        ([("scream", 0.0, 1.0), ("siren", 2.0, 3.0), ("whale", 4.0, 5.0)], "A person screaming is followed by a siren and whale.", "Nghe thấy tiếng hét hoảng loạn, sau đó là tiếng còi hú và whale."),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, detections array<struct<class_id: string, onset: double, offset: double>>")
    for r in X.captions(df).collect():
        assert (r.caption_en, r.caption_vi) == cases[r.i][1:]


def test_document_and_answer(spark):
    ts = dt.datetime(2026, 9, 16, 17, 56)
    df = spark.createDataFrame([("c", ["scream"], ts, "Cổng", "school", "HIGH"), ("c", [], ts, None, None, None)], "caption_vi string, class_ids array<string>, window_start timestamp, location string, area_type string, severity string")
    a, b = (r[0] for r in df.select(X.document()).collect())
    assert a == "tiếng hét hoảng loạn\nscream\nc\nCổng (trường học)\n00:56 ngày 17/09/2026, ban đêm\nmức cao"
    assert b == f"{V.NO_CLASS_VI}\nc\n00:56 ngày 17/09/2026, ban đêm"
    found = spark.createDataFrame([(1, "EVT_1", ts, "x", "HIGH", 0.7), (1, "EVT_2", ts, "y", "LOW", 0.9)], "question_id int, event_id string, window_start timestamp, caption_vi string, severity string, similarity double")
    got = {r.question_id: r.answer for r in X.answers(found, spark.createDataFrame([(1,), (2,)], "question_id int")).collect()}
    assert got[2] == V.NO_EVIDENCE_VI and got[1].split("\n")[1].endswith("y (mức thấp, EVT_2)")


def test_phrases_and_negation(spark):
    texts = spark.createDataFrame([(1, "A gun fire, then Shots fired."), (2, "no one heard a gunshot"), (3, "It isn't a gunshot"), (4, "no wind at all in the street, gunshot"), (5, None), (6, "gunshots")], "id int, text string")
    lex = spark.createDataFrame([("gunshot", "en", p) for p in ("gunshot", "gunshots", "gun fire", "shots fired")], "class_id string, lang string, phrase string")
    assert {r.id: r.n for r in X.phrase_matches(texts, lex, key="id").collect()} == {1: 2, 4: 1, 6: 1}


def test_lexicon_match_counts_as_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from murmur import catalogue

    rows = [(1, "no one of THE two"), (2, "then't ain't of"), (3, "\u0130of Of"), (4, None), (5, "and, and"), (6, "without the and")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(db.execute(catalogue.ORACLES["lexicon_match"]).fetchall())
    assert want == {"the": 2, "of": 3, "and": 3} and {r.class_id: r.n for r in catalogue.QUERIES["lexicon_match"](spark, str(tmp_path)).collect()} == want


def test_ece_exact_cases(spark):
    df = spark.createDataFrame([("a", 0.3, float(i < 3)) for i in range(10)] + [("b", 0.99, float(i < 2)) for i in range(10)], "c string, p double, y double")
    got = {r.group: r.ece for r in metrics.ece(df, "p", "y", group="c").collect()}
    assert got["a"] == pytest.approx(0) and got["b"] == pytest.approx(0.79) and got["pooled"] == pytest.approx(0.395)
    bins = metrics.reliability(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "p double, y double"), "p", "y").orderBy("bin").collect()
    assert [r.n for r in bins] == [1] + [0] * 8 + [1] and bins[4].mean_prob is None


def test_unmeasured_stays_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    got = {r.metric: (r["mean"], r.n_measured, r.n_unmeasured) for r in metrics.mean_measured(df, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 2, 1), "b": (None, 0, 3)}
    cap = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["b"])], "said array<string>, true array<string>")
    assert [(r.ehr, r.eor) for r in metrics.caption_scores(cap).collect()] == [(0.5, 0.5), (None, 1.0)]
    audit = spark.createDataFrame([("a, b; c", "c", "d"), ("", None, "")], "extracted string, wrong string, missing string")
    r = metrics.lexicon_audit(audit).first()
    assert (r.precision, r.recall, r.exact_rate) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5)


def test_weighted_percentiles(spark):
    df = spark.createDataFrame([("u", float(v)) for v in range(1, 101)], "c string, v double")
    got = {r.share: r.value for r in metrics.weighted_percentiles(metrics.class_weights(df, "c"), "v", "weight", [0.05, 0.5, 0.95]).collect()}
    for q, v in got.items():
        assert abs(v - np.percentile(np.arange(1, 101), q * 100)) <= 1.0
    mix = spark.createDataFrame([("a", 1.0)] * 1000 + [("b", 9.0)] * 10, "c string, v double")
    assert metrics.weighted_percentiles(metrics.class_weights(mix, "c"), "v", "weight", [0.6]).first().value == 9.0


def test_matching_is_one_to_one(spark):
    rows = [("c", "s", "reference", 1.0, 2.0), ("c", "s", "reference", 5.0, 6.0), ("c", "s", "predicted", 1.1, 2.0), ("c", "s", "predicted", 1.15, 2.0), ("c", "t", "predicted", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "clip string, class_id string, side string, onset double, offset double")
    r = metrics.f1(metrics.event_counts(df, key=["clip", "class_id"])).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1) and r.mean_shift == pytest.approx(0.1)


def test_ks(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(100)] + [(500.0, 0)], "v double, s int")
    r = metrics.ks(df, "v", F.col("s") == 0).first()
    assert (r.n_a, r.n_b) == (51, 50) and 0 < r.ks < 0.1


def test_exclusions_and_leaks(spark):
    kept = spark.createDataFrame([("f1", "d1"), ("f2", "d1"), ("f1", "d2")], "file_id string, stage string")
    done = spark.createDataFrame([("f1",)], "file_id string")
    new = spark.createDataFrame([("f9", "d1")], "file_id string, stage string")
    assert sorted(tuple(r) for r in provenance.merge_exclusions(kept, done, new, "d1").collect()) == [("f1", "d2"), ("f2", "d1"), ("f9", "d1")]
    df = spark.createDataFrame([("s", "dev"), ("s", "train"), ("t", "dev"), ("t", "dev")], "src string, split string")
    assert [r.src for r in provenance.leaked(df, "src", "split").collect()] == ["s"]
    with pytest.raises(Exception, match="unknown source: t"):
        provenance.required(df, spark.createDataFrame([("s", 1)], "src string, x int"), "src", "source").collect()
    parts = provenance.group_split(df, "src", [("dev", 0.6), ("gold", 0.4)], "seed").groupBy("src").agg(F.countDistinct(F.col("split")).alias("n")).collect()
    assert all(r.n == 1 for r in parts)


def test_inventory_and_contamination(spark):
    clips = spark.createDataFrame([("a", 60.0, "x"), ("a", 60.0, "y"), ("a", 60.0, "x"), ("b", 30.0, "x")], "class_id string, duration_bank double, source_dataset string")
    goals = spark.createDataFrame([("a", 3, 1), ("b", 2, 1), ("c", 2, 1), ("d", 0, 0)], "class_id string, target int, least int")
    got = {r.class_id: (r.n, r.minutes, r.sources, r.status) for r in provenance.inventory(clips, goals).collect()}
    assert got == {"a": (3, 3.0, ["x", "y"], "ok"), "b": (1, 0.5, ["x"], "short"), "c": (0, 0.0, [], "missing"), "d": (0, 0.0, [], None)}
    frames = spark.createDataFrame([("p", "scream", 0.15), ("q", "siren", 0.2), ("q", "scream", 0.9)], "clip string, class_id string, prob double")
    c = {r.clip: (r.class_id, r.prob, r.verdict) for r in provenance.contamination(frames, spark.createDataFrame([("p",), ("q",), ("r",)], "clip string")).collect()}
    assert c == {"p": ("", 0.0, "clean"), "q": ("scream", 0.9, "flagged"), "r": ("", 0.0, "clean")}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "parent string, child string")
    got = {tuple(r) for r in graph.ancestors(e).collect()}
    assert got == {("b", "a"), ("c", "b"), ("c", "a"), ("y", "x"), ("x", "y"), ("x", "x"), ("y", "y")}
    labels = spark.createDataFrame([(1, "c"), (1, "a"), (2, "a")], "key int, label string")
    assert sorted(tuple(r) for r in graph.most_specific(labels, graph.ancestors(e), "key").collect()) == [(1, "c"), (2, "a")]
    g = graph.groups(spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (3, "q"), (9, "z")], "i int, k string"), "i", "k")
    assert {r.i: r.group for r in g.collect()} == {1: 1, 2: 1, 3: 1, 9: 9}


def test_ancestors_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(50, 48)], "parent int, child int")
    want = {(b, a) for a in range(51) for b in range(a + 1, 51)} | {(b, a) for b in (48, 49, 50) for a in (48, 49, 50)}
    closure = graph.ancestors(e)
    assert sorted(tuple(r) for r in closure.collect()) == sorted(want)
    labels = spark.createDataFrame([(1, 0), (1, 47), (2, 3)], "key int, label int")
    assert sorted(tuple(r) for r in graph.most_specific(labels, closure, "key").collect()) == [(1, 47), (2, 3)]


def test_dup_groups_over_the_whole_table(spark, tmp_path):
    from murmur import catalogue

    rows = [(1, 7, 7, 1), (1, 8, 8, 2), (2, 8, 8, 3), (2, 9, 9, 1), (3, 9, 9, 2), (4, 7, 6, 1), (5, 5, 5, 4)]
    r = random.Random(9)
    rows += [(100 + r.randrange(60), r.randrange(20), r.randrange(5), 1 + r.randrange(7)) for _ in range(90)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {i: i for i, *_ in rows}
    for _ in want:
        for a in rows:
            for b in rows:
                if a[1:3] == b[1:3]:
                    want[a[0]] = want[b[0]] = min(want[a[0]], want[b[0]])
    got = catalogue.QUERIES["dup_groups"](spark, str(tmp_path)).collect()
    assert {x.l_orderkey: x.group for x in got} == want and len(got) == len(want) and len(set(want.values())) > 2


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(np.linspace(0, 3, 20))] + [(99, None)], "event_id int, embedding array<double>")
    ids = lambda k: [r.event_id for r in vectors.nearest(df, [1.0, 0.0], k=k).collect()]
    assert ids(3) == [0, 1, 2] and ids(4)[:3] == ids(3)
    assert vectors.nearest(df, [1.0, 0.0], k=None, min_similarity=0.52).count() == 7
    n = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(S.l2_normalised("v")).collect()
    assert [r[0] for r in n] == [[0.6, 0.8], [0.0, 0.0]]


def test_batch_of_more_queries_than_a_block(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None)], "vec_id long, embedding array<double>")
    q = df.where("vec_id < 25").select(F.col("vec_id").alias("query_id"), "embedding")
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {(a, b, k + 1) for a in range(25) for k, b in enumerate(sorted(x, key=lambda i: -x[a] @ x[i])[:3])}
    for size in (4, 1000):
        got = vectors.nearest_batch(df, q, k=3, id_col="vec_id", max_queries=size).collect()
        assert {(g.query_id, g.vec_id, g["rank"]) for g in got} == want and len(got) == len(want)
    assert vectors.nearest_batch(df, q.limit(0), k=3, id_col="vec_id").count() == 0


def test_batch_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(9, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [2.0, 0.0]), (4, [0.0, 0.0]), (3, [1.0]), (7, [nan, 1.0]), (6, [None, 1.0]), (8, None), (1, []), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    q = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 0.0]), ("c", None)], "query_id string, embedding array<float>")
    for size in (1, 3, 100):
        got = vectors.nearest_batch(df, q, k=6, id_col="vec_id", max_queries=size, max_rows=size)
        assert got.columns == ["query_id", "vec_id", "similarity", "rank"]
        by = {}
        for r in sorted(got.collect(), key=lambda r: r["rank"]):
            by.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
        assert [i for i, _ in by["a"]] == [7, 2, 5, 9, 0, 1] and [s for _, s in by["a"]][1:] == [1.0, 1.0, 1.0, 0.0, None]
        assert [i for i, _ in by["b"]] == [7, 0, 1, 2, 3, 4]
        assert by["c"] == [(i, None) for i in range(6)]


def test_batch_takes_no_pair_to_a_row(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q = df.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    plan = vectors.nearest_batch(df, q, k=2, id_col="vec_id")
    assert "MapInArrow" in plan._jdf.queryExecution().toString() and "Generate" not in plan._jdf.queryExecution().toString()
    assert plan.where("query_id = vec_id AND similarity > 0.999999").count() == 300


def test_signal_kernels():
    rate = 8000
    t = np.arange(rate) / rate
    rir = np.random.default_rng(1).normal(size=rate) * 10 ** (-3 * t / 0.5)
    assert abs(signal.rt60_of(rir, rate) - 0.5) < 0.125 and signal.rt60_of(np.zeros(100), rate) == 0.0
    x = np.zeros(16000, np.float32)
    x[6000:9000] = 0.5
    a, z = signal.voiced(x)
    assert a <= 6000 < 9000 <= z and z - a < 6000
    assert signal.flat_runs(np.array([1.0, 1.0, 1.0, 0.0, 1.0])) == pytest.approx(0.6)
    assert signal.measure(b"junk")["loi"] and signal.measure(b"junk")["dur"] is None
