"""Placement, gap study, slices, waveforms and bundles."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import placement, provenance, studies
from murmur.sources import readers, waves


def free_of(taken, lo, hi):
    out, at = [], lo
    for s, e in sorted((max(s, lo), min(e, hi)) for s, e in taken if e > s):
        if s >= e:
            continue
        if s > at:
            out.append((at, s))
        at = max(at, e)
    return out + ([(at, hi)] if at < hi else [])


def clips_of(seed):
    r = random.Random(seed)
    clips, taken, new = [], [], []
    for k in range(60):
        key = f"c{k}" if k else None
        lo = r.choice([0, 100])
        clips.append((key, lo, lo + 1000))
        for _ in range(r.choice([0, 1, 3, 12])):
            s = r.randrange(lo - 50, lo + 1040)
            taken.append((key, s, s + r.choice([0, 5, 60, 300])))
        new.append((key, k, r.choice([0, 1, 40, 300, 700, 1000, 1500])))
    return clips, taken, new


def frames(spark, clips, taken, new):
    return spark.createDataFrame(new, "clip string, id int, length long"), spark.createDataFrame(taken, "clip string, start long, end long"), spark.createDataFrame(clips, "clip string, lo long, hi long")


@pytest.mark.parametrize("width", [64, 5000])
def test_free_space_equals_brute_force(spark, width):
    clips, taken, new = clips_of(1)
    _, t, c = frames(spark, clips, taken, new)
    got = sorted((x.clip or "", x.gap_start, x.gap_end) for x in placement.free(t, c, ["clip"], width=width).collect())
    assert got == sorted((k or "", *g) for k, lo, hi in clips for g in free_of([x[1:] for x in taken if x[0] == k], lo, hi))


def test_placed_events_overlap_nothing_where_a_gap_fits(spark):
    clips, taken, new = clips_of(2)
    n, t, c = frames(spark, clips, taken, new)
    got = placement.place(n, t, c, ["clip"], id_col="id", width=128, seed=5).collect()
    again = placement.place(n, t.repartition(3), c, ["clip"], id_col="id", width=128, seed=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(new)
    ends = {k: (lo, hi) for k, lo, hi in clips}
    fitted = 0
    for x in got:
        mine = [y[1:] for y in taken if y[0] == x.clip]
        length = next(z[2] for z in new if z[1] == x.id)
        gaps = free_of(mine, *ends[x.clip])
        assert x.end - x.start == length and x.fits == any(b - a >= length for a, b in gaps)
        if x.fits:
            fitted += 1
            assert any(a <= x.start and x.end <= b for a, b in gaps) and x.overlap == 0
        else:
            inside = free_of(mine, x.start, x.end)
            assert x.overlap >= min(length, 1000) - sum(b - a for a, b in inside) - 500 and x.start >= ends[x.clip][0]
    assert 10 < fitted < len(new)


def test_gaps_are_taken_in_proportion_to_their_length(spark):
    n = 3000
    clips = spark.range(n).select(F.col("id").cast("string").alias("clip"), F.lit(0).cast("long").alias("lo"), F.lit(1000).cast("long").alias("hi"))
    taken = clips.select("clip", F.lit(100).cast("long").alias("start"), F.lit(400).cast("long").alias("end"))  # gaps of 100 and 600
    new = clips.select("clip", F.col("clip").alias("id"), F.lit(10).cast("long").alias("length"))
    got = placement.place(new, taken, clips, ["clip"], id_col="id", width=1000).select((F.col("start") < 100).alias("first")).groupBy("first").count().collect()
    share = next(x["count"] for x in got if x["first"]) / n
    assert abs(share - 1 / 7) < 0.03


def test_events_of_a_clip_see_those_placed_before(spark):
    clips = spark.createDataFrame([("a", 0, 100), ("b", 0, 30)], "clip string, lo long, hi long")
    taken = spark.createDataFrame([], "clip string, start long, end long")
    new = spark.createDataFrame([(c, i, 9, i) for c in "ab" for i in range(4)], "clip string, id int, length long, turn int")
    got = placement.place_in_turn(new, taken, clips, ["clip"], id_col="id", turn="turn", width=50, seed=1).collect()
    for c in "ab":
        mine = sorted((x.start, x.end) for x in got if x.clip == c and x.fits)
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))
    assert len(got) == 8 and sum(x.fits for x in got if x.clip == "a") >= 3


def sound(*levels, rate=100):
    return [float(x) for x in levels for _ in range(rate)]


def study(spark, reference, predicted, wavs, **kw):
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(reference)], "id int, clip string, class_id string, onset double, offset double")
    p = spark.createDataFrame(predicted, "clip string, class_id string, onset double, offset double")
    s = studies.samples(spark.createDataFrame([(k, v, 100) for k, v in wavs.items()], "clip string, samples array<double>, sample_rate int"), ["clip"])
    return {x.id: x for x in studies.long_event_gaps(r, p, s, ["clip"], id_col="id", hop=0.05, bucket=1.0, **kw).collect()}


def test_gap_study_from_sound(spark):
    wavs = {"a": sound(1, 1, 0, 1, 1), "b": sound(1, 1)}
    got = study(spark, [("a", "siren", 0.0, 5.0), ("a", "shot", 4.9, 5.2), ("b", "siren", 0.0, 2.0), ("c", "siren", 0.0, 3.0)], [("a", "siren", 0.0, 2.0), ("a", "siren", 3.0, 5.0), ("b", "siren", 0.0, 2.0), ("b", "shot", 0.0, 2.0)], wavs)
    assert sorted(got) == [0, 2, 3]  # the short one is out
    assert got[0].fragmented and got[0].gap == pytest.approx(1.0)
    assert not got[2].fragmented and got[2].gap == 0.0 and got[3].gap is None and not got[3].fragmented
    assert study(spark, [("a", "shot", 0.0, 0.3)], [], wavs) == {}


def test_gap_study_ends_in_one_join(spark):
    e = spark.range(20).select("id", F.lit("a").alias("clip"), F.lit("x").alias("class_id"), F.col("id").cast("double").alias("onset"), (F.col("id") + 9.0).alias("offset"))
    s = spark.range(40).select(F.lit("a").alias("clip"), F.col("id").cast("double").alias("at"), (F.col("id") % 3).cast("double").alias("x"))
    got = studies.long_event_gaps(e, e, s, ["clip"], id_col="id", hop=1.0, bucket=5.0, share=0.5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2 and "Window" not in plan  # hits with their predictions, and all facts with the events
    assert {(r.id, r.fragmented, r.gap) for r in got.collect()} == {(i, True, 1.0) for i in range(20)}


def test_short_events_are_dropped_below_the_joins(spark):
    e = spark.range(10).select(F.col("id"), F.lit("a").alias("clip"), F.lit("x").alias("class_id"), F.lit(0.0).alias("onset"), F.col("id").cast("double").alias("offset"))
    levels = studies.hop_levels(e.where(F.col("offset") - F.col("onset") >= 5), e.select("clip", F.col("offset").alias("at"), F.lit(1.0).alias("x")), ["clip"], id_col="id", hop=1.0, bucket=10.0)
    plan = levels._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index(">= 5")  # the filter lies below the join


def test_slices_count_a_clip_in_each(spark):
    counts = spark.createDataFrame([("a", "x", 1, 0, 1), ("a", "y", 1, 1, 0), ("b", "x", 0, 2, 0)], "clip string, class_id string, tp long, fp long, fn long")
    slices = spark.createDataFrame([("a", ["long", "snr", "long"]), ("b", ["snr"]), ("c", None), ("d", [])], "clip string, slices array<string>")
    got = {x.slice: tuple(x)[1:5] for x in studies.slice_grid(counts, slices, ["clip"]).collect()}
    assert got == {"long": (1, 2, 1, 1), "snr": (2, 2, 3, 1), "all": (4, 2, 3, 1)}
    cross = {(x.long, x.snr): (x.n_clips, x.tp, x.f1) for x in studies.cross_cuts(counts, slices, ["clip"], "long", "snr").collect()}
    assert cross[True, True] == (1, 2, 4 / 6) and cross[False, True][:2] == (1, 0) and cross[None, None][:2] == (4, 2) and (True, False) not in cross


def stored(folder, rows, clips, name="dev"):
    np.save(f"{folder}/{name}_wave32k.npy", rows)
    (folder / f"{name}_meta.json").write_text(json.dumps({"class_ids": ["x", "y"], "duration": 10.0, "clips": clips}))


def test_waveforms_are_read_by_position(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(waves, "PART_BYTES", 2000)
    x = np.arange(50 * 100, dtype=np.int16).reshape(50, 100) - 2500
    clips = [{"clip_id": f"c{i}", "events": [[i % 2, 0.5, 1.0 + i]] if i % 3 else []} for i in range(50)]
    stored(tmp_path, x, clips)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        df = waves.waves(spark, path, "dev")
        got = {r.position: r for r in df.withColumn("f", waves.as_float("samples")).collect()}
        assert len(got) == 50
        for i in range(50):
            assert got[i].clip == f"c{i}" and got[i].samples == x[i].tolist() and [tuple(e) for e in got[i].events] == [(c, a, b) for c, a, b in clips[i]["events"]]
        assert got[0].f[0] == pytest.approx(x[0, 0] / 32767, rel=1e-6)


def test_a_sidecar_of_another_length_is_fatal_before_any_task(spark, tmp_path):
    stored(tmp_path, np.zeros((3, 10), np.int16), [{"clip_id": "a", "events": []}])
    with pytest.raises(Exception, match="3 rows but the sidecar 1 clips"):
        waves.waves(spark, str(tmp_path), "dev")._jdf.queryExecution().executedPlan().toString()
        waves.waves(spark, str(tmp_path), "dev").count()
    stored(tmp_path, np.zeros((3, 10), np.float32), [{"clip_id": "a", "events": []}] * 3, "bad")
    with pytest.raises(Exception, match="16-bit"):
        waves.waves(spark, str(tmp_path), "bad").count()


def test_silent_clips_survive_the_bundle(spark, tmp_path):
    clips = spark.createDataFrame([("a", 1001), ("silent", 1001)], "clip string, n_frames int")
    segments = spark.createDataFrame([(c, i, "x", 0.25) for c in ("a", "silent") for i in range(3)], "clip string, seg int, class_id string, prob double")
    events = spark.createDataFrame([("a", "x", 1.0, 2.0), ("a", "y", 0.5, 0.75)], "clip string, class_id string, onset double, offset double")
    waves.write_bundle(clips, segments, events, str(tmp_path / "b"))
    waves.write_bundle(clips, segments, events, str(tmp_path / "b"))  # replaced, not added to
    got = {r.clip: r for r in readers.predictions(spark, str(tmp_path / "b")).collect()}
    assert [tuple(e) for e in got["a"].events] == [(0.5, 0.75, "y"), (1.0, 2.0, "x")] and got["silent"].events == [] and len(got["silent"].segments) == 3
    with pytest.raises(Exception, match="unknown clip: zz"):
        waves.write_bundle(clips, segments, events.withColumn("clip", F.lit("zz")), str(tmp_path / "c"))


def test_clips_of_one_video_are_one_source(spark):
    df = spark.createDataFrame([("f1", "v1"), ("f2", "v1"), ("f3", "v2"), ("f4", None)], "file_name string, video_id string")
    assert tuple(waves.source_videos(df).first()) == (4, 2)


def test_label_vectors_keep_silent_clips_and_refuse_unknown_classes(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "clip string, class_id string")
    clips = spark.createDataFrame([("a",), ("b",), ("silent",)], "clip string")
    got = {r.clip: r.labels for r in studies.label_vectors(e, clips, ["clip"], ["x", "y", "z"]).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "silent": [0, 0, 0]}
    with pytest.raises(Exception, match="unknown class: y"):
        studies.label_vectors(e, clips, ["clip"], ["x"]).collect()


def test_sources_without_a_rule_stop(spark):
    rules = spark.createDataFrame([("bank", ["train", "dev"]), ("gold", ["test"])], "source string, splits array<string>")
    rows = spark.createDataFrame([("bank", "train"), ("bank", "test"), ("gold", "test")], "source string, split string")
    assert sorted(map(tuple, provenance.eligible(rows, rules, "source", "split").collect())) == [("bank", "train"), ("gold", "test")]
    with pytest.raises(Exception, match="unknown source: new"):
        provenance.eligible(rows.union(spark.createDataFrame([("new", "train")], rows.schema)), rules, "source", "split").collect()
    names = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    assert sorted(map(str, provenance.unmapped(names, names.where("name = 'a'"), "name").collect())) == ["Row(name='b', n=2)", "Row(name=None, n=1)"]
