"""Kernels on sound: decoding, trimming, reverberation, levels.  Arrow-batched Python, as these have no relational form."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_DB = 40.0


def decode_wav(data: bytes, rate: int | None = None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 of a PCM WAV file, at its own rate or linearly resampled to the given one."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / float(1 << 23)
    else:
        raise ValueError(f"samples of {width} bytes")
    x = x.reshape(-1, channels).mean(axis=1) if channels > 1 else x
    if rate and rate != own and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x).astype(np.float32)
        own = rate
    return x, own


def voiced(x: np.ndarray, top_db: float = TOP_DB, frame: int = 2048, hop: int = 512) -> tuple[int, int]:
    """First and last sample (half open) of the frames within top_db of the loudest frame; (0, 0) for silence."""
    if not len(x) or not np.abs(x).max() > 0:
        return 0, 0
    pad = np.pad(x.astype(np.float64), frame // 2)
    total = np.concatenate([[0.0], np.cumsum(pad * pad)])
    at = np.arange(0, len(pad) - frame + 1, hop)
    power = (total[at + frame] - total[at]) / frame
    loud = np.flatnonzero(power > power.max() * 10 ** (-top_db / 10))
    return int(loud[0] * hop), int(min(len(x), (loud[-1] + 1) * hop))


def measure(data: bytes) -> dict:
    """Bank measures of a WAV file; what cannot be decoded gives its error in ``loi`` and no measures."""
    none = dict.fromkeys(("dur", "eff", "lead", "trail", "rms_db", "peak"))
    try:
        x, rate = decode_wav(data)
    except Exception as e:  # the error is the row's content
        return none | {"loi": f"{type(e).__name__}: {e}"}
    if not len(x):
        return none | {"loi": "empty file"}
    a, z = voiced(x)
    n = len(x)
    rms = float(np.sqrt(np.mean(x[a:z] ** 2))) if z > a else 0.0
    lead = a if z > a else n
    return {"dur": n / rate, "eff": (z - a) / rate, "lead": lead / rate, "trail": (n - z) / rate if z > a else 0.0, "rms_db": round(20 * float(np.log10(max(rms, 1e-10))), 2) if z > a else -120.0, "peak": float(np.abs(x).max()), "loi": ""}


def probe(files: DataFrame) -> DataFrame:
    """(path, dur, eff, lead, trail, rms_db, peak, loi) of binaryFile rows; lead + eff + trail is dur."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([{"path": path} | measure(bytes(c)) for path, c in zip(p["path"], p["content"])], columns=["path", "dur", "eff", "lead", "trail", "rms_db", "peak", "loi"])

    return files.select("path", "content").mapInPandas(run, "path string, dur double, eff double, lead double, trail double, rms_db double, peak double, loi string")


def rt60_of(x: np.ndarray, rate: int) -> float:
    """Reverberation time of an impulse response from the slope of its backward integral between -5 and -25 dB; 0 for silence."""
    energy = np.cumsum((np.asarray(x, np.float64) ** 2)[::-1])[::-1]
    if not len(energy) or energy[0] <= 0:
        return 0.0
    db = 10 * np.log10(np.maximum(energy / energy[0], 1e-12))
    part = np.flatnonzero((db <= -5) & (db >= -25))
    if len(part) < 2:
        return 0.0
    slope = np.polyfit(part / rate, db[part], 1)[0]
    return float(-60 / slope) if slope < 0 else 0.0


def trimmed_rir(x: np.ndarray, rate: int, most: float = 2.0) -> np.ndarray:
    """The response from its first arrival on, most seconds at most."""
    if not len(x) or not np.abs(x).max() > 0:
        return x
    first = int(np.flatnonzero(np.abs(x) >= np.abs(x).max() * 0.1)[0])
    return x[first : first + int(most * rate)]


def energy_normalised(samples: str) -> Column:
    """The samples at an energy of 1; all zeros stay."""
    e = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(e > 0, F.transform(samples, lambda v: v.cast("double") / e)).otherwise(F.transform(samples, lambda v: v.cast("double")))


def with_rt60(df: DataFrame, samples: str, rate: int, out: str = "rt60_sec") -> DataFrame:
    @F.pandas_udf("double")
    def kernel(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else rt60_of(np.asarray(v, np.float64), rate))

    return df.withColumn(out, kernel(samples))


def rms_envelope(x: np.ndarray, rate: int, onset: float, offset: float, hop: float = 0.01) -> np.ndarray:
    """Root mean squares of non-overlapping hops within [onset, offset]."""
    part = np.asarray(x, np.float64)[int(onset * rate) : int(offset * rate)]
    n = max(1, int(hop * rate))
    return np.sqrt((part[: len(part) // n * n].reshape(-1, n) ** 2).mean(axis=1)) if len(part) >= n else np.zeros(0)


def flat_runs(x: np.ndarray, ceiling: float = 0.999, least: int = 3) -> float:
    """Share of samples in runs of at least ``least`` at the ceiling."""
    hot = np.concatenate([[0], (np.abs(x) >= ceiling).astype(np.int8), [0]])
    step = np.diff(hot)
    size = np.flatnonzero(step == -1) - np.flatnonzero(step == 1)
    return float(size[size >= least].sum() / len(x)) if len(x) else 0.0


def mixed(a: np.ndarray, b: np.ndarray, ya: np.ndarray, yb: np.ndarray, alpha: float, seed: int, hard: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mixup of two batches with one Beta(alpha, alpha) share; labels are mixed, or with hard their union; alpha of 0 or less changes nothing."""
    if alpha <= 0:
        return a, ya
    share = np.random.default_rng(seed).beta(alpha, alpha)
    return share * a + (1 - share) * b, np.maximum(ya, yb) if hard else share * ya + (1 - share) * yb


def apply_model(files: DataFrame, make: Callable[[], Callable[[bytes], list[tuple[int, int, float]]]]) -> DataFrame:
    """(path, frame, code, prob) from a tagger over binaryFile rows; make() builds it once a task.  No weights come with the library."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for p in parts:
            yield pd.DataFrame([(path, f, c, q) for path, data in zip(p["path"], p["content"]) for f, c, q in model(bytes(data))], columns=["path", "frame", "code", "prob"])

    return files.select("path", "content").mapInPandas(run, "path string, frame int, code int, prob double")
