"""Placing events into the free space of their clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.intervals import merged, overlap_join
from murmur.operators.order import running
from murmur.sources.checkpoints import written

#: Positions that are tried where no gap fits.
TRIES = 16


def uniform(seed: int, which: Column, *ids: Column) -> Column:
    """A number from 0 up to but not including 1 that seed, draw and ids fix."""
    text = F.concat_ws(":", F.lit(str(seed)), which.cast("string"), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def free(taken: DataFrame, clips: DataFrame, key: list[str], *, width: int) -> DataFrame:
    """(key, gap_start, gap_end): what the intervals (key, start, end) leave of each clip (key, lo, hi), its ends included; a clip
    without intervals is one gap.  Keys are dealt by stretches of the given width."""
    spans = clips.select(*[F.col(k).alias(f"_{k}") for k in key], "lo", "hi")
    cut = taken.join(spans, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).select(*key, F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end"))
    edges = clips.select(*key, F.explode(F.array(F.struct(F.col("lo").alias("start"), F.lit(0).alias("t")), F.struct(F.col("hi").alias("start"), F.lit(2).alias("t")))).alias("x"))
    rows = merged(cut, key, bucket=width).select(*key, "start", "end", F.lit(1).alias("t")).unionByName(edges.select(*key, F.col("x.start").alias("start"), F.col("x.start").alias("end"), F.col("x.t").alias("t")))
    before = running(rows, key, ["start", "t", "end"], F.floor(F.col("start") / width), {}, tops={"reach": F.col("end")})
    return before.where("reach < start").select(*key, F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))


def place(new: DataFrame, taken: DataFrame, clips: DataFrame, key: list[str], *, id_col: str, width: int, seed: int = 0) -> DataFrame:
    """(key, id, start, end, fits, overlap): where each new event (key, id, length) goes in its clip.

    Of the gaps that are long enough one is drawn in proportion to its length, by a hashed number on the cumulative lengths, and
    the event starts anywhere in it that keeps it inside.  Where none is, 16 positions are tried and the one that overlaps the
    taken intervals least counts, the first of equals; an event longer than its clip starts with it.  All times are whole
    units, and ids, seed and tables fix the result.  Several new events of a clip are placed without regard to each other.
    """
    name = [F.col(k) for k in key] + [F.col(id_col)]
    ids = [*key, id_col]
    gaps = free(taken, clips, key, width=width)
    n = new.select(*[F.col(k).alias(f"_{k}") for k in key], id_col, "length")
    room = gaps.join(n, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).where("gap_end - gap_start >= length").select(*ids, "length", "gap_start", (F.col("gap_end") - F.col("gap_start")).alias("gap"))
    room = running(room, ids, ["gap_start"], F.floor(F.col("gap_start") / width), {"before": F.col("gap")})
    aim = F.floor(uniform(seed, F.lit(0), *name) * F.col("before_all"))
    hit = room.where((F.col("before") <= aim) & (aim < F.col("before") + F.col("gap")))
    start = F.col("gap_start") + F.floor(uniform(seed, F.lit(1), *name) * (F.col("gap") - F.col("length") + 1))
    inside = written(hit.select(*ids, start.alias("start"), (start + F.col("length")).alias("end")), "placed")
    got = inside.select(*[F.col(k).alias(f"_{k}") for k in ids])
    tight = new.join(got, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ids], "left_anti").select(*ids, "length")
    spans = clips.select(*[F.col(k).alias(f"_{k}") for k in key], "lo", "hi")
    tight = tight.join(spans, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).select(*ids, "length", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))).alias("try"))
    at = F.col("lo") + F.floor(uniform(seed, F.col("try") + 2, *name) * (F.greatest(F.col("hi") - F.col("lo") - F.col("length"), F.lit(0)) + 1))
    tries = tight.select(*ids, "try", at.alias("start"), (at + F.col("length")).alias("end"))
    met = overlap_join(tries, merged(taken.select(*key, "start", "end"), key, bucket=width), key, width=width)
    shared = F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("_o")
    found = met.groupBy(*[F.col(k).alias(f"_{k}") for k in ids], F.col("try").alias("_try")).agg(shared)
    scored = tries.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ids] + [F.col("try") == F.col("_try")], "left").withColumn("overlap", F.coalesce("_o", F.lit(0)))
    best = scored.groupBy(*ids).agg(F.min(F.struct("overlap", "try", "start", "end")).alias("b"))
    fit = inside.select(*ids, "start", "end", F.lit(True).alias("fits"), F.lit(0).cast("long").alias("overlap"))
    return fit.unionByName(best.select(*ids, "b.start", "b.end", F.lit(False).alias("fits"), F.col("b.overlap").alias("overlap")))


def place_in_turn(new: DataFrame, taken: DataFrame, clips: DataFrame, key: list[str], *, id_col: str, turn: str, width: int, seed: int = 0) -> DataFrame:
    """place() for several events a clip: those of a turn (0, 1, ...) see what the turns before them took.  A round a turn, over
    all clips at once; each is written."""
    out = None
    for n in range((new.agg(F.max(turn)).first()[0] or 0) + 1):
        step = written(place(new.where(F.col(turn) == n), taken, clips, key, id_col=id_col, width=width, seed=seed), "turn")
        out = step if out is None else out.unionByName(step)
        taken = taken.select(*key, "start", "end").unionByName(step.select(*key, "start", "end"))
    return out
