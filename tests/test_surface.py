"""Sources, sinks, serving, streams and the entry points."""

import datetime as dt
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur import schema
from murmur.functions import vocabulary as V
from murmur.operators import signal
from murmur.plans import serving
from murmur.sources import readers, sinks
from murmur.streaming import alerts


def wav(samples, rate=16000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_annotations(spark, tmp_path):
    def item(label, role, t=1.0):
        return {"time": t, "duration": 2.0, "value": {"label": label, "role": role, "source_file": "x", "pitch_shift": None}}

    (tmp_path / "b.jams").write_text(json.dumps({"annotations": [{"data": [item("scream", "foreground"), item("school", "background")]}, {"data": [item("siren", "foreground")]}]}, indent=1))
    (tmp_path / "a.jams").write_text(json.dumps({"annotations": [{"data": [item("park", "background")]}]}))
    (tmp_path / "b.wav").write_bytes(wav([0.1] * 10))
    got = readers.annotations(spark, str(tmp_path), ["scream"]).collect()
    assert [tuple(r) for r in got] == [("b", "scream", 1.0, 3.0)]
    with pytest.raises(Exception, match="unknown label"):
        readers.annotations(spark, str(tmp_path), ["siren"]).collect()
    assert [r.clip for r in readers.paired(spark, str(tmp_path), str(tmp_path)).collect()] == ["b"]


def test_bank(spark, tmp_path):
    d = tmp_path / "scream"
    d.mkdir()
    x = np.zeros(16000)
    x[4000:8000] = 0.5
    (d / "one.wav").write_bytes(wav(x))
    (d / "bad.wav").write_bytes(b"no sound")
    rows = {r.path.split("/")[-1]: r for r in signal.probe(readers.bank(spark, str(tmp_path))).collect()}
    one = rows["one.wav"]
    assert one.lead + one.eff + one.trail == pytest.approx(one.dur) and one.loi == ""
    assert rows["bad.wav"].loi and rows["bad.wav"].dur is None


def test_absent_files_are_empty(spark, tmp_path):
    assert readers.exclusions(spark, str(tmp_path / "none.csv")).count() == 0
    assert readers.slice_index(spark, str(tmp_path / "none.jsonl")) is None
    assert {r.name: r.json for r in readers.run_results(spark, {"a": str(tmp_path / "none.json")}).collect()} == {"a": None}


def events(spark):
    rows = [(f"EVT_20260917_{i:06d}", dt.datetime(2026, 9, 17, i), None, f"loc{i % 2}", "e", "v", "HIGH" if i % 3 else "LOW", 0.5, "" if i % 2 else "x.wav", [1.0, float(i)], None, None, None) for i in range(1, 9)]
    d = [(r[0], k, "scream" if k else "siren", float(2 - k), 3.0, 0.5) for r in rows[:4] for k in range(2)]
    return spark.createDataFrame(rows, schema.EVENT), spark.createDataFrame(d, schema.DETECTION), spark.createDataFrame([("loc0", "Gate", "school", None)], schema.LOCATION)


def test_listing_and_detail(spark):
    e, d, loc = events(spark)
    page, total = serving.listing(e, d, loc, where=serving.filters(level="HIGH"), limit=2, offset=1)
    assert [r.event_id[-1] for r in page.collect()] == ["7", "5"] and total.first().total == 6
    assert {r.event_id[-1]: r.n_detections for r in serving.listing(e, d, loc)[0].collect()}["8"] == 0
    assert serving.listing(e, d, loc, class_id="scream")[1].first().total == 4
    one = serving.detail(e, d, "EVT_20260917_000002").first()
    assert [x.onset for x in one.detections] == [1.0, 2.0] and one.has_audio
    with pytest.raises(ValueError):
        serving.page_bounds(201)
    assert serving.shown_filters({"a": "", "b": "x"}) == {"b": "x", "limit": V.PAGE_DEFAULT}
    with pytest.raises(ValueError):
        serving.provider("oracle")
    assert serving.fail("x", "y")["success"] is False and serving.ok(1, total=3)["meta"] == {"total": 3}


def test_ask_refuses_without_evidence(spark):
    e, _, _ = events(spark)
    answer, cites = serving.ask(e, [1.0, 0.0], min_similarity=0.999)
    assert answer.first().answer == V.NO_EVIDENCE_VI and cites.count() == 0
    answer, cites = serving.ask(e, [1.0, 1.0], k=2)
    assert cites.count() == 2 and answer.first().answer.startswith("Tìm thấy 2")


def test_ingest(spark):
    w = spark.createDataFrame([("w1", dt.datetime(2026, 9, 17, 1), 10.0, "loc0", None), ("w2", dt.datetime(2026, 9, 17, 2), 10.0, None, None)], "window_key string, window_start timestamp, duration double, location_id string, audio_path string")
    d = spark.createDataFrame([("w1", 0, "gunshot", 1.0, 2.0, 0.9)], "window_key string, ord int, class_id string, onset double, offset double, confidence double")
    e, kids = serving.ingest(w, d, V.tiers(spark, {"gunshot": "Critical"}), events(spark)[2], latest={"20260917": 41})
    rows = {r.window_key: r for r in e.collect()}
    assert (rows["w1"].event_id, rows["w1"].severity) == ("EVT_20260917_000042", "CRITICAL")
    assert (rows["w2"].severity, rows["w2"].caption_en) == ("LOW", V.NO_EVENT_EN)
    assert [r.event_id for r in kids.collect()] == ["EVT_20260917_000042"]


def test_seed_feedback_predictions(spark, tmp_path):
    want = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    assert sinks.seed(want, want.where("id = 'a'"), "id", str(tmp_path / "t")) == 1
    assert sinks.seed(want, want, "id", str(tmp_path / "t")) == 0
    e, _, _ = events(spark)
    f = spark.createDataFrame([("EVT_20260917_000001",), ("nope",)], "event_id string")
    good, bad = sinks.feedback(f, e)
    assert good.count() == 1 and bad.first().event_id == "nope"
    for name, df in {"clips": spark.createDataFrame([("a",), ("b",)], "clip string"), "segments": spark.createDataFrame([("a", 0, "x", 0.5)], "clip string, seg int, class_id string, prob float"), "events": spark.createDataFrame([("a", 0.0, 1.0, "x")], "clip string, onset double, offset double, class_id string")}.items():
        df.write.parquet(str(tmp_path / "bundle" / name))
    assert {r.clip: len(r.events) for r in readers.predictions(spark, str(tmp_path / "bundle")).collect()} == {"a": 1, "b": 0}
    assert "chưa đo" in sinks.markdown([{"a": None, "b": 0.5}], ["a", "b"]) and "0,5000" in sinks.markdown([{"a": None, "b": 0.5}], ["a", "b"])


def test_alert_stream(spark, tmp_path):
    e, _, _ = events(spark)
    e.write.parquet(str(tmp_path / "in"))
    got = []
    q = alerts.alert_stream(alerts.replay(spark, str(tmp_path / "in"), schema.EVENT), str(tmp_path / "cp"), lambda df, i: got.extend(r.message for r in df.select("message").collect()), once=True)
    q.awaitTermination(60)
    assert len(got) == 6 and all('"severity":"HIGH"' in m for m in got)
    clients = {"a": lambda m: None, "dead": lambda m: 1 / 0}
    assert alerts.broadcast(got[:2], clients) == 2 and list(clients) == ["a"]
    assert alerts.newest(e, 3).count() == 3


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_llm_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['murmur.llm'] = None\nimport importlib.util as u\nf = u.find_spec\nu.find_spec = lambda n, *a: None if n in ('murmur.llm', 'corpus_pipeline') else f(n, *a)\nimport __spark_entry__ as e\nassert e.queries() and not [k for k in e.queries() if k.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_tables_read(spark):
    df = readers.table(spark, "/root/testdata/sf0.001", "events")
    assert df.where(F.col("value") > 0).count() > 0
