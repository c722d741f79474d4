"""Runs, windows and sequences along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import vocabulary as V
from murmur.functions.scalars import rounded
from murmur.operators.order import running
from murmur.operators.quantiles import percentiles


#: Frames of a bucket: a task holds one bucket of a key at a time.
BUCKET = 1024


def longest_run(df: DataFrame, key: list[str], order: list[str], flag: Column, bucket: Column | None = None) -> DataFrame:
    """(key, start, end): half-open positions from 0 of the longest run of rows with a true flag, the first of equals.
    Keys without a true flag give no row; a null flag is false.  ``bucket`` does not decrease along the order and deals a key
    over tasks; without it a key is one bucket."""
    rows = running(df.withColumn("_f", F.coalesce(flag, F.lit(False))), key, order, F.lit(0) if bucket is None else bucket, {"_p": F.lit(1)})
    return placed_run(rows, key, F.col("_f"))


def placed_run(rows: DataFrame, key: list[str], flag: Column) -> DataFrame:
    """longest_run over rows with place ``_p`` in their key and bucket ``_b``, as running() gives them.

    A bucket is summed up by its first, its last and its longest run; only those meet in a key, where runs that touch across
    buckets are joined."""
    true = rows.where(flag).select(*key, "_b", "_p")
    true = true.withColumn("_i", F.col("_p") - F.row_number().over(Window.partitionBy(*key, "_b").orderBy("_p")))
    found = true.groupBy(*key, "_b", "_i").agg(F.min("_p").alias("s"), (F.max("_p") + 1).alias("e"))
    run = F.struct("s", "e")
    most = F.max_by(run, F.struct((F.col("e") - F.col("s")), (-F.col("s"))))
    few = found.groupBy(*key, "_b").agg(F.array_distinct(F.array(F.min(run), F.max(run), most)).alias("r")).select(*key, F.explode("r").alias("r")).select(*key, "r.*")
    w = Window.partitionBy(*key).orderBy("s")
    opened = few.withColumn("_n", F.when(F.col("s") == F.lag("e").over(w), 0).otherwise(1))
    islands = opened.withColumn("_g", F.sum("_n").over(w)).groupBy(*key, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    best = islands.groupBy(*key).agg(F.max(F.struct((F.col("e") - F.col("s")).alias("n"), (-F.col("s")).alias("s"))).alias("m"))
    return best.select(*key, (-F.col("m.s")).cast("long").alias("start"), (F.col("m.n") - F.col("m.s")).cast("long").alias("end"))


def boundaries(frames: DataFrame, key: list[str], *, frame: str = "frame", prob: str = "prob", duration: str = "duration", order: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """(key, onset, offset, peak): the longest run of frames at half the peak or more, widened by a pad and kept in the
    clip; the whole clip where the peak is 0.  duration is a column of frames, equal for all frames of a key.  Frames are in
    the order of their number and dealt by it; ``order`` and ``bucket`` give another order and what deals it."""
    stats = frames.groupBy(*key).agg(F.max(prob).alias("peak"), F.count("*").alias("n"), F.max(duration).alias("duration"))
    bucket = F.floor(F.col(frame) / BUCKET) if bucket is None else bucket
    marked = running(frames, key, order or [frame], bucket, {"_p": F.lit(1)}, {"_peak": F.col(prob)})
    runs = placed_run(marked, key, (F.col("_peak") > 0) & (F.col(prob) >= F.col("_peak") * V.BOUNDARY_FRACTION))
    step = F.col("duration") / F.col("n")
    onset = F.coalesce(rounded(F.greatest(F.lit(0.0), F.col("start") * step - V.BOUNDARY_PAD), 3), F.lit(0.0))
    offset = F.coalesce(rounded(F.least(F.col("duration"), F.col("end") * step + V.BOUNDARY_PAD), 3), F.greatest("duration", F.lit(0.0)))
    return stats.join(runs, key, "left").select(*key, onset.alias("onset"), offset.alias("offset"), "peak")


def detections(frames: DataFrame, codes: DataFrame, *, clip: str = "clip", duration: str = "duration", threshold: float = V.DETECTION_THRESHOLD) -> DataFrame:
    """Detections (clip, ord, class_id, onset, offset, confidence) from frame probabilities by code: a class takes the
    greatest of its codes in each frame; clips below the threshold at their peak give none; ordered by onset, then class.
    codes is (class_id, code), a taxonomy small enough to be sent to every task."""
    by_class = frames.join(F.broadcast(codes.select("class_id", "code")), "code").groupBy(clip, "class_id", "frame").agg(F.max("prob").alias("prob"), F.max(duration).alias("duration"))
    found = boundaries(by_class, [clip, "class_id"], duration="duration").where(F.col("peak") >= threshold)
    order = F.row_number().over(Window.partitionBy(clip).orderBy("onset", "class_id")) - 1
    return found.select(clip, order.alias("ord"), "class_id", "onset", "offset", rounded("peak", 4).alias("confidence"))


def median_filter(df: DataFrame, key: list[str], order: list[str], value: str, size: int = 7) -> DataFrame:
    """df with ``median``: the middle of the size rows around each row of its key, in order; at the ends of a key the
    window is cut short, and of an even number the upper middle counts.  size is odd and 51 at most."""
    if size % 2 == 0 or not 1 <= size <= 51:
        raise ValueError("the window is odd and 51 at most")
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(size // 2), size // 2)
    near = F.sort_array(F.collect_list(value).over(w))
    return df.withColumn("_near", near).withColumn("median", F.col("_near")[F.floor(F.size("_near") / 2).cast("int")]).drop("_near")


def widths(events: DataFrame, class_col: str, length: str, *, step: float, most: int = 51) -> DataFrame:
    """(class, width): frames of the median filter of each class: the 25th percentile of its events' lengths in frames of
    ``step``, made odd downwards, 1 at least and 51 at most.  From training events, so that no label of the scored set is used."""
    q = percentiles(events, length, [0.25], [class_col])
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("value") / step))).cast("int")
    return q.select(class_col, (n - (n % 2 == 0).cast("int")).alias("width"))


def median_filter_by(df: DataFrame, key: list[str], order: list[str], value: str, width: str, bucket: Column) -> DataFrame:
    """median_filter with the row's own window in column ``width``, odd and 51 at most, equal for all rows of a key.

    Rows get places in their key by buckets; stretches of 1,024 places, with the 25 rows beside them on either side, become
    arrays whose slices are sorted, so a key of any length is dealt over tasks.  A width that is even, null or out of bounds is
    an error."""
    ok = F.col(width).between(1, 51) & (F.col(width) % 2 == 1)
    half = F.when(F.coalesce(ok, F.lit(False)), F.col(width)).otherwise(F.raise_error(F.lit("the window is odd and 51 at most"))) / 2
    rows = running(df, key, order, bucket, {"_p": F.lit(1)}).drop("_b").withColumn("_h", F.floor(half).cast("int"))
    near = F.array_distinct(F.transform(F.array(*[F.lit(x) for x in (-25, 0, 25)]), lambda x: F.floor((F.col("_p") + x) / BUCKET)))
    dealt = rows.withColumn("_s", F.explode(F.filter(near, lambda s: s >= 0)))
    kept = F.struct(F.col("_p"), F.col(value).alias("v"), F.col("_h"), F.struct(*[c for c in df.columns if c not in key]).alias("row"))
    stretches = dealt.groupBy(*key, "_s").agg(F.array_sort(F.collect_list(kept), lambda x, y: F.when(x["_p"] < y["_p"], -1).otherwise(1)).alias("a"))
    stretches = stretches.select(*key, "_s", "a", F.transform("a", lambda x: x["v"]).alias("vs"), F.posexplode("a").alias("i", "x")).where(F.floor(F.col("x._p") / BUCKET) == F.col("_s"))
    lo = F.greatest(F.lit(0), F.col("i") - F.col("x._h"))
    hi = F.least(F.size("vs") - 1, F.col("i") + F.col("x._h"))
    cut = F.sort_array(F.slice("vs", lo + 1, hi - lo + 1))
    return stretches.select(*key, "x.row.*", F.get(cut, F.floor((hi - lo + 1) / 2).cast("int")).alias("median")).select(*df.columns, "median")


def daily_numbers(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """df with ``number``: from 1 each day of ts, in order of time.  Rows are numbered within minutes, after the counts of the
    minutes before, so a day is dealt over tasks."""
    rows = running(df.withColumn("_day", F.to_date(ts)), ["_day"], [ts, tie], F.date_trunc("minute", ts), {"number": F.lit(1)})
    return rows.withColumn("number", F.col("number") + 1).drop("_day", "_b", "number_all")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order, compared as a struct; aggregated, not sorted."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def round_robin_sample(df: DataFrame, strata: Column, order: list[Column], n: int) -> DataFrame:
    """n rows, taken in turn from each stratum; within one by the order.  Strata that are empty are passed over.  No stratum
    sends more than n rows to the last order."""
    rows = df.withColumn("_s", strata)
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy(*order)))
    return rows.where(F.col("_k") <= n).orderBy("_k", "_s", *order).limit(n).drop("_k", "_s")


def chains(df: DataFrame, key: list[str], steps: tuple[str, ...], pauses: tuple[tuple[float, float], ...], *, class_col: str = "class_id", start: str = "onset", end: str = "offset", tie: str = "ord", unit: float = 1.0) -> DataFrame:
    """(key, first, last, start, end) where consecutive detections of a key, by start, are of the given classes, and
    each pause from an end to the next start is within its bounds, in units of time."""
    w = Window.partitionBy(*key).orderBy(start, tie)
    rows = df
    ok = F.col(class_col) == steps[0]
    for i, (name, (lo, hi)) in enumerate(zip(steps[1:], pauses), 1):
        before = F.col(end) if i == 1 else F.col(f"_e{i - 1}")
        rows = rows.withColumn(f"_c{i}", F.lead(class_col, i).over(w)).withColumn(f"_s{i}", F.lead(start, i).over(w)).withColumn(f"_e{i}", F.lead(end, i).over(w)).withColumn(f"_t{i}", F.lead(tie, i).over(w))
        pause = F.col(f"_s{i}") - before
        ok = ok & (F.col(f"_c{i}") == name) & (pause >= lo * unit) & (pause <= hi * unit)
    k = len(steps) - 1
    return rows.where(ok).select(*key, F.col(tie).alias("first"), F.col(f"_t{k}").alias("last"), F.col(start).alias("start"), F.col(f"_e{k}").alias("end"))


def expand_frames(df: DataFrame, key: list[str], *, n_frames: int, duration: float, start: str = "onset", end: str = "offset") -> DataFrame:
    """(key, frame): the frames that each interval touches, one at least, each once a key."""
    lo = F.least(F.lit(n_frames - 1), F.greatest(F.lit(0), F.floor(F.col(start) / duration * n_frames)))
    hi = F.least(F.lit(n_frames), F.greatest(lo + 1, F.ceil(F.col(end) / duration * n_frames)))
    return df.select(*key, F.explode(F.sequence(lo.cast("int"), (hi - 1).cast("int"))).alias("frame")).distinct()


def rebuild_frames(segments: DataFrame, key: list[str], *, per_segment: int, n_frames: int, seg: str = "seg", value: str = "prob") -> DataFrame:
    """(key, frame, value): each segment repeated per_segment times, the last one for the frames that are left; more
    segments than frames hold is an error."""
    last = F.max(seg).over(Window.partitionBy(*key))
    s = segments.withColumn("_last", last)
    most = (n_frames + per_segment - 1) // per_segment
    s = s.withColumn("_n", F.when(F.col("_last") < most, F.lit(n_frames)).otherwise(F.raise_error(F.lit("more segments than frames"))))
    stop = F.when(F.col(seg) == F.col("_last"), F.col("_n")).otherwise((F.col(seg) + 1) * per_segment)
    frame = F.explode(F.sequence((F.col(seg) * per_segment).cast("int"), (stop - 1).cast("int"))).alias("frame")
    return s.select(*key, frame, F.col(value).alias("value"))
