"""Stored waveforms of a split, an array file and its sidecar, as a Spark data source; prediction bundles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCALE = 32767.0
#: Bytes of samples in a partition and in an Arrow batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20

SCHEMA = "position long, clip string, events array<struct<class_idx: int, onset: double, offset: double>>, samples array<smallint>"


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return fs.open_input_file(path)


def _header(uri: str) -> tuple[int, int, int]:
    """(rows, samples a row, where the data begins) of a two-dimensional array file of int16."""
    with _open(uri) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        if fortran or kind != np.dtype("<i2") or len(shape) != 2:
            raise ValueError(f"{uri} is not an array of rows of 16-bit samples")
        return shape[0], shape[1], f.tell()


class Rows(InputPartition):
    """Consecutive rows of the array with what the sidecar says of them."""

    def __init__(self, first: int, clips: list[dict]):
        self.first, self.clips = first, clips


class WaveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        folder, split, rate = options["path"].rstrip("/"), options["split"], int(options.get("rate", "32000"))
        self.wave, self.meta = f"{folder}/{split}_wave{rate // 1000}k.npy", f"{folder}/{split}_meta.json"

    def partitions(self) -> list[Rows]:
        """Planned from the sidecar; another number of clips there than rows in the array is an error before any task runs."""
        with _open(self.meta) as f:
            clips = json.loads(f.read().decode("utf-8"))["clips"]
        rows, samples, _ = _header(self.wave)
        if rows != len(clips):
            raise ValueError(f"the array has {rows} rows but the sidecar {len(clips)} clips: the files do not belong together")
        step = max(1, PART_BYTES // max(1, 2 * samples))
        return [Rows(i, clips[i : i + step]) for i in range(0, rows, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        """Opened by the task that reads it; some rows at a time."""
        _, n, begin = _header(self.wave)
        event = pa.struct([("class_idx", pa.int32()), ("onset", pa.float64()), ("offset", pa.float64())])
        step = max(1, BATCH_BYTES // max(1, 2 * n))
        with _open(self.wave) as f:
            for at in range(0, len(partition.clips), step):
                clips = partition.clips[at : at + step]
                f.seek(begin + (partition.first + at) * n * 2)
                x = pa.array(np.frombuffer(f.read(len(clips) * n * 2), "<i2"))
                events = pa.array([[(int(c), float(a), float(b)) for c, a, b in r["events"]] for r in clips], pa.list_(event))
                offsets = pa.array(np.arange(len(clips) + 1, dtype=np.int32) * n)
                position = pa.array(range(partition.first + at, partition.first + at + len(clips)), pa.int64())
                yield pa.record_batch([position, pa.array([r["clip_id"] for r in clips], pa.string()), events, pa.ListArray.from_arrays(offsets, x)], ["position", "clip", "events", "samples"])


class WaveSource(DataSource):
    """Format "waves": options path, split and rate (32000)."""

    @classmethod
    def name(cls) -> str:
        return "waves"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WaveReader:
        return WaveReader(dict(self.options))


def waves(spark: SparkSession, folder: str, split: str, *, rate: int = 32000) -> DataFrame:
    """(position, clip, events, samples) of a split; silent clips have no events, samples are 16-bit."""
    spark.dataSource.register(WaveSource)
    return spark.read.format("waves").option("path", folder).option("split", split).option("rate", str(rate)).load()


def as_float(samples):
    """16-bit samples as numbers from -1 to 1."""
    return F.transform(samples, lambda x: (x / SCALE).cast("float"))


def write_bundle(clips: DataFrame, segments: DataFrame, events: DataFrame, folder: str) -> None:
    """A prediction bundle: clips (clip, ...), segments (clip, seg, class_id, prob) and reference events (clip, class_id, onset,
    offset), each a table of the folder, replaced as a whole.  Segments or events of a clip that the clips lack are an error
    when they are written; a clip without either is kept."""
    for name, df in (("segments", segments), ("events", events)):
        known = clips.select(F.col("clip").alias("_known")).distinct()
        checked = df.join(known, F.col("clip") == F.col("_known"), "left")
        ok = F.when(F.col("_known").isNotNull(), F.col("clip")).otherwise(F.raise_error(F.concat(F.lit(f"{name} of an unknown clip: "), F.coalesce("clip", F.lit("null")))))
        checked.withColumn("clip", ok).drop("_known").write.mode("overwrite").parquet(f"{folder}/{name}")
    clips.write.mode("overwrite").parquet(f"{folder}/clips")


def source_videos(clips: DataFrame) -> DataFrame:
    """One row: clips and distinct source videos of crash metadata."""
    return clips.agg(F.count("*").alias("n_clips"), F.count_distinct("video_id").alias("n_videos"))
