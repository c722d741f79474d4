"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B, TS = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _of(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


LOCATION = _of(("location_id", S), ("name", S), ("area_type", S), ("floor", S))
DETECTION = _of(("event_id", S), ("ord", T.IntegerType()), ("class_id", S), ("onset", D), ("offset", D), ("confidence", D))
EVENT = _of(
    ("event_id", S), ("window_start", TS), ("window_end", TS), ("location_id", S), ("caption_en", S), ("caption_vi", S), ("severity", S), ("risk_score", D), ("audio_path", S),
    ("embedding", T.ArrayType(T.FloatType())), ("grounding_score", D), ("model_versions", T.MapType(S, S)), ("created_at", TS),
)
FEEDBACK = _of(("event_id", S), ("is_true_alarm", B), ("correct_classes", T.ArrayType(S)), ("caption_ok", B), ("note", S), ("reviewed_by", S), ("reviewed_at", TS))
METRIC = _of(("ts", TS), ("latency_ms", D), ("class_histogram", T.MapType(S, L)))
TAXONOMY = _of(("class_id", S), ("tier", S), ("group", S), ("audioset_ids", T.ArrayType(S)))
FRAME = _of(("clip", S), ("frame", T.IntegerType()), ("code", T.IntegerType()), ("prob", D))
ANNOTATION = _of(("clip", S), ("class_id", S), ("onset", D), ("offset", D))
WAVEFORM = _of(("clip", S), ("samples", T.ArrayType(T.ShortType())))
BANK = _of(("file_id", S), ("class_id", S), ("path", S), ("dur", D), ("eff", D), ("lead", D), ("trail", D), ("rms_db", D), ("peak", D), ("loi", S))
EXCLUSION = _of(("file_id", S), ("stage", S), ("reason_code", S), ("detail", S), ("decided_by", S), ("decided_at", S))
ALERT = _of(("event_id", S), ("severity", S), ("risk_score", D), ("caption_vi", S), ("location_id", S), ("window_start", TS))
LEXICON = _of(("class_id", S), ("lang", S), ("phrase", S))
SLICE_INDEX = _of(("clip_id", S), ("slices", T.ArrayType(S)), ("n_events", T.IntegerType()), ("chain", S))
MANIFEST = _of(("file_id", S), ("split", S), ("duration", D), ("claimed_class", S))
CRASH_CLIPS = _of(("file_name", S), ("label", S), ("start_sec", D), ("end_sec", D), ("duration_sec", D), ("title", S), ("channel", S), ("video_id", S), ("source_url", S), ("license", S))
