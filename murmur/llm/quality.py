"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text (labelled good documents) and one of raw text
(all documents), give each document the log of its importance weight; Gumbel noise on top of it, and the k
greatest sums, sample k documents without replacement in proportion to the weights.

Features of a word: the word, the pair with the word before it (one feature for all pairs of equal words), and
its shape (letter case of the first byte, last two bytes).  The log weight is the mean over a document's
features times LENGTH, so that it does not grow with the document's length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import materialise, ship
from murmur.llm._words import U, buffers, give_back, hashes, mix, sliced, spans

#: Buckets of each of the three kinds: few, so that each is well known from few labelled documents.
RANGE = 1 << 12
BUCKETS = 3 * RANGE
LENGTH = 100.0
#: Labelled rows that the target model is fitted on, at most: those of the least hashed ids.
LABELLED = 20_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each text in order, and the row offsets among them (three a word)."""
    text, offsets = buffers(texts)
    h, rows = hashes(text, offsets, fold=None)
    if not len(h):
        return np.zeros(0, np.int64), rows * 3
    first, last, before = [], [], []
    for s, e in spans(text, offsets):
        first.append(text[s])
        last.append(text[e - 1])
        before.append(text[np.maximum(e - 2, s)])
    first, last, before = np.concatenate(first), np.concatenate(last), np.concatenate(before)
    upper = (first >= 65) & (first <= 90)
    shape = mix(upper.astype(U) << U(16) | before.astype(U) << U(8) | last.astype(U) | U(1 << 20))
    prev = np.concatenate([[U(1)], h[:-1]])
    prev[rows[:-1][rows[:-1] < len(h)]] = U(1)
    pair = mix(prev * U(3) + h)
    out = np.empty(3 * len(h), np.int64)
    out[0::3] = (h & U(RANGE - 1)).astype(np.int64)
    out[1::3] = RANGE + np.where(prev == h, 0, 1 + pair % U(RANGE - 1)).astype(np.int64)
    out[2::3] = 2 * RANGE + (shape & U(RANGE - 1)).astype(np.int64)
    return out, rows * 3


def _per_row(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of each row, which other rows don't change in the last digit."""
    out = np.zeros(len(rows) - 1)
    some = rows[1:] > rows[:-1]
    if some.any():
        out[some] = np.add.reduceat(x, rows[:-1][some])
    return out


class Weights:
    """The fitted log ratios by bucket, and the log weight from which on a document counts as good."""

    def __init__(self, ratio: np.ndarray, cut: float):
        self.ratio, self.cut = ratio, cut


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Weights:
    """Fit both models: the raw one on all docs, the target one on the labelled good ones among at most
    ``labelled`` rows of labels, which also give the cut, a quarter of the way from the greatest weight of bad
    ones to the least of good ones, outside 1 % of either.  Without good labels all ratios are 0; without bad ones nothing is cut.
    The driver receives the labelled ids and BUCKETS counts.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("q"))
    rows = known.orderBy(F.xxhash64("id"), "id").limit(labelled).toArrow()
    marks = dict(zip(rows["id"].to_pylist(), [int(q) for q in rows["q"].to_pylist()]))
    marks_b = spark.sparkContext.broadcast(marks)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good, bad = (np.zeros(BUCKETS, np.int64) for _ in range(3))
        for b in sliced(batches):
            f, rows = features(b.column(1))
            raw += np.bincount(f, minlength=BUCKETS)
            for i, d in enumerate(b.column(0).to_pylist()):
                m = marks_b.value.get(d)
                if m is not None and rows[i + 1] > rows[i]:
                    np.add.at(good if m else bad, f[rows[i] : rows[i + 1]], 1)
        some = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], ["b", "raw", "good"])

    got = source.mapInArrow(count, "b int, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[np.asarray(got["b"], np.int64)], good[np.asarray(got["b"], np.int64)] = np.asarray(got["raw"], float), np.asarray(got["good"], float)
    if not good.sum():
        return Weights(np.zeros(BUCKETS), -math.inf)
    # a hundredth of the target counts is shared out as raw text is, so that nothing is impossible
    prior = (raw + 1) / (raw + 1).sum()
    extra = 0.01 * good.sum()
    ratio = np.log((good + extra * prior) / (good.sum() + extra)) - np.log(prior)
    fitted = Weights(ratio, -math.inf)
    ids = sorted(marks)
    keep = F.broadcast(spark.createDataFrame([(i, marks[i]) for i in ids], f"i {dict(source.dtypes)[id_col]}, q int"))  # LABELLED rows at most
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = weigh(text.join(keep, text["id"] == keep["i"]).select("i", "text", "q"), fitted, text_col="text", out_col="w")
    scored = scored.groupBy("i").agg(F.min("q").alias("q"), F.min("w").alias("w")).toArrow()  # a row for each labelled id at most
    q, w = np.asarray(scored["q"]), np.asarray(scored["w"])
    yes, no = np.sort(w[q > 0]), np.sort(w[q <= 0])
    if not len(no):
        return fitted
    low, high = no[min(len(no) - 1, len(no) * 99 // 100)], yes[len(yes) // 100]
    fitted.cut = float(low + 0.25 * (high - low))
    return fitted


def weigh(df: DataFrame, weights: Weights, *, text_col: str = "text", out_col: str = "log_weight") -> DataFrame:
    """df with the log importance weight of each text: the log ratio of the two models a feature, times LENGTH, that is the
    log ratio of the whole text tempered to a text of LENGTH features, so that long texts are not weighed beyond all noise
    and short ones not below it.  0 for null, empty and blank texts."""
    ship(df.sparkSession)
    ratio = df.sparkSession.sparkContext.broadcast(weights.ratio)

    @F.arrow_udf("double")
    def weight(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for at in range(0, len(texts), 2000):
            f, rows = features(texts.slice(at, 2000))
            n = np.diff(rows)
            out.append(np.where(n > 0, _per_row(ratio.value[f], rows) / np.maximum(n, 1) * LENGTH, 0.0))
        give_back()
        return pa.array(np.concatenate(out))

    return df.withColumn(out_col, weight(F.col(text_col).cast("string")))


def kth_greatest(df: DataFrame, column: str, k: int) -> float:
    """The k-th greatest value of a double column, exactly, by narrowing a range; the driver sees a thousand values at a time."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return math.inf
    above = 0
    while True:
        part = df.where(F.col(column).between(lo, hi))
        width = (hi - lo) / 1000
        if part.limit(1001).count() <= 1000 or width <= 0 or lo + width == lo:
            values = sorted((r[0] for r in part.select(column).limit(1000).collect()), reverse=True)
            return values[min(k - above, len(values)) - 1]
        bins = {r[0]: (r[1], r[2], r[3]) for r in part.groupBy(F.least(F.floor((F.col(column) - F.lit(lo)) / width), F.lit(999)).alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(bins, reverse=True):
            if above + bins[b][0] >= k:
                lo, hi = bins[b][1], bins[b][2]
                break
            above += bins[b][0]


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, seed: int = 1, labelled: int = LABELLED) -> DataFrame:
    """docs with log_weight, gumbel_key (log weight plus Gumbel noise from a hash of id and seed) and kept: whether
    the key is among the k greatest.  Rows that tie with the k-th, which have its id and text, are kept as well.

    k defaults to how many documents weigh as much as the fitted cut, so junk has next to no chance.  Null, empty and
    blank texts weigh 0.  Columns of docs with the new names are replaced, all others stay.  No docs give no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("log_weight", "gumbel_key", "kept")])
    weights = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, labelled=labelled)
    # a uniform number in (0, 1) from 52 bits of a hash
    u = (F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    keyed = weigh(docs, weights, text_col=text_col).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    keys = materialise(keyed.select("log_weight", "gumbel_key"), "keys")
    if k is None:
        k = keys.where(F.col("log_weight") >= weights.cut).count()
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(float(kth_greatest(keys, "gumbel_key", k))))
