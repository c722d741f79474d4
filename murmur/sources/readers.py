"""Readers of annotations, ontologies, banks, manifests and stored tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import schema
from murmur.functions import vocabulary as V

OBSERVATION = "struct<time: double, duration: double, value: struct<label: string, source_file: string, source_time: double, event_time: double, event_duration: double, snr: double, role: string, pitch_shift: double, time_stretch: double>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, if there is one; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def annotations(spark: SparkSession, folder: str, known: list[str] | None = None) -> DataFrame:
    """(clip, class_id, onset, offset) of the foreground observations in the first annotation of each JAMS file; clips
    without any give no row.  A label that is not known is an error."""
    raw = spark.read.schema(f"annotations array<struct<data: array<{OBSERVATION}>>>").option("multiLine", True).json(f"{folder}/*.jams")
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.jams$", "")
    rows = raw.select(name.alias("clip"), F.explode(F.col("annotations")[0]["data"]).alias("o")).where("o.value.role = 'foreground'")
    label = F.col("o.value.label")
    if known is not None:
        label = F.when(label.isin(known), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))
    return rows.select("clip", label.alias("class_id"), F.col("o.time").alias("onset"), (F.col("o.time") + F.col("o.duration")).alias("offset"))


def stems(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(clip, path, length) of the files with a suffix, wherever they lie under the folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder)
    return files.select(F.expr(f"substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - {len(suffix)})").alias("clip"), "path", "length")


def paired(spark: SparkSession, annotated: str, sounds: str, limit: int | None = None) -> DataFrame:
    """Clips with both an annotation file and a sound, in order of name; the first ``limit`` of them if given."""
    df = stems(spark, annotated, ".jams").select("clip", F.col("path").alias("jams")).join(stems(spark, sounds, ".wav").select("clip", F.col("path").alias("wav")), "clip").orderBy("clip")
    return df.limit(limit) if limit is not None else df


def bank(spark: SparkSession, folder: str) -> DataFrame:
    """binaryFile rows of <class>/*.wav with file_id and class_id; a missing folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    parts = F.split("path", "/")
    return files.withColumn("class_id", F.element_at(parts, -2)).withColumn("file_id", F.regexp_replace(F.element_at(parts, -1), r"\.wav$", ""))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """binaryFile rows with ``status``: 400 for empty files, 413 above the upload limit, else 200."""
    files = spark.read.format("binaryFile").load(folder)
    return files.withColumn("status", F.when(F.col("length") == 0, 400).when(F.col("length") > V.UPLOAD_MOST, 413).otherwise(200))


def ontology_edges(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) from a JSON list of nodes with id and child_ids."""
    nodes = spark.read.schema("id string, name string, child_ids array<string>").option("multiLine", True).json(path)
    return nodes.select(F.col("id").alias("parent"), F.explode("child_ids").alias("child"))


def parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def taxonomy(spark: SparkSession, spec: dict) -> DataFrame:
    """Taxonomy rows from a parsed mapping {"classes": {class: {tier, group, audioset_ids}}}; ordered by group, those
    without one last, then class."""
    rows = [(c, s.get("tier"), s.get("group"), list(s.get("audioset_ids") or [])) for c, s in spec["classes"].items()]
    return spark.createDataFrame(rows, schema.TAXONOMY).orderBy(F.coalesce("group", F.lit("Z")), "class_id")


def codes(tax: DataFrame, labels: DataFrame, ontology: DataFrame) -> DataFrame:
    """(class_id, code): model output columns of each class.  labels is (code, name), ontology (id, name, ordinal); of names
    that repeat there the last counts.  Classes without any are absent."""
    last = ontology.groupBy("name").agg(F.max_by("id", "ordinal").alias("id"))
    index = labels.join(last, "name").select("id", "code")
    return tax.select("class_id", F.explode("audioset_ids").alias("id")).join(index, "id").select("class_id", "code")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """The exclusion ledger; no file is an empty ledger."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema.EXCLUSION)
    return spark.read.csv(path, header=True, schema=schema.EXCLUSION)


def crash_clips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema.CRASH_CLIPS)


def slice_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The slice index of a synthetic set, or None if there is no file."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.schema(schema.SLICE_INDEX).json(path)


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(clip, segments, events) of a stored bundle; clips without events keep an empty array."""
    clips, segments, events = (spark.read.parquet(f"{folder}/{n}") for n in ("clips", "segments", "events"))
    s = segments.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("seg", "class_id", "prob"))).alias("segments"))
    e = events.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("onset", "offset", "class_id"))).alias("events"))
    empty = F.array().cast("array<struct<onset: double, offset: double, class_id: string>>")
    return clips.join(s, "clip", "left").join(e, "clip", "left").withColumn("events", F.coalesce("events", empty))


def run_results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row of the JSON results of a run, a column a file; a file that is absent is null."""
    out = []
    for name, path in paths.items():
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
        text = spark.read.text(path, wholetext=True).first()[0] if there else None
        out.append((name, None if text is None else json.dumps(json.loads(text))))
    return spark.createDataFrame(out, "name string, json string")
