"""One-to-one matching of reference and predicted events by onset, by rounds of mutually nearest pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.checkpoints import written

#: Collars in a stretch of time: what one window of a task holds of a key.
STRETCH = 256


def matched(events: DataFrame, key: list[str], *, collar: float, stretch: int = STRETCH) -> DataFrame:
    """(key, reference, predicted, n): n pairs of a reference event at the onset ``reference`` and a predicted one at the onset
    ``predicted``, from rows (key, side, onset), side reference or predicted.

    Pairs are those of the greedy rule: of all pairs within the collar, nearest first, then the earliest reference, then the
    earliest prediction, each event once.  Every pair that is the first of the rule for both its events is one of them, so a
    round takes all such pairs at once and the next round goes on with what is left.  Such events are neighbours in time
    among those left, so a round looks at neighbours and makes no pairs that it does not take: events of a side that share an
    onset are counted as one row, stretches of time see a collar beyond their ends, and a busy key is dealt over tasks.  An
    event without a partner in reach is out for good.  Events with a null onset match nothing.
    """
    reach = collar + 1e-9
    onset = F.col("onset").cast("double")
    cells = events.where(F.col("onset").isNotNull() & F.col("side").isin("reference", "predicted")).select(*key, onset.alias("onset"), (F.col("side") == "reference").alias("ref"))
    cells = cells.groupBy(*key, "onset").agg(F.count_if("ref").alias("r"), F.count_if(~F.col("ref")).alias("p"))
    cells = written(cells, "onsets")
    same = cells.where("r > 0 AND p > 0").select(*key, F.col("onset").alias("reference"), F.col("onset").alias("predicted"), F.least("r", "p").alias("n"))
    left = cells.where("r <> p").select(*key, "onset", (F.col("r") > F.col("p")).alias("ref"), F.abs(F.col("r") - F.col("p")).alias("n"))
    found, width = [same], reach * stretch if reach > 0 else 1.0
    while True:
        near = written(_neighbours(left, key, reach, width), "neighbours")
        pairs = near.groupBy(*key, "reference", "predicted").agg(F.max(F.when(F.col("ref"), F.col("n"))).alias("r"), F.max(F.when(~F.col("ref"), F.col("n"))).alias("p")).where("r IS NOT NULL AND p IS NOT NULL")
        pairs = written(pairs.select(*key, "reference", "predicted", F.least("r", "p").alias("n")), "pairs")
        if pairs.isEmpty():
            return _all(found)
        found.append(pairs)
        taken = pairs.select(*[F.col(k).alias(f"_{k}") for k in key], F.explode(F.array(F.struct(F.lit(True).alias("s"), F.col("reference").alias("o")), F.struct(F.lit(False).alias("s"), F.col("predicted").alias("o")))).alias("x"), F.col("n").alias("_n"))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key] + [F.col("onset") == F.col("x.o"), F.col("ref") == F.col("x.s")]
        rest = near.join(taken, on, "left").withColumn("n", F.col("n") - F.coalesce("_n", F.lit(0)))
        left = rest.where("n > 0").select(*key, "onset", "ref", "n")


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out


def _neighbours(left: DataFrame, key: list[str], reach: float, width: float) -> DataFrame:
    """Rows (key, onset, ref, n) with the pair (reference, predicted) that each would take first; those without one are out."""
    home = F.floor(F.col("onset") / width)
    seen = F.array_distinct(F.array(home, F.floor((F.col("onset") - reach) / width), F.floor((F.col("onset") + reach) / width)))
    dealt = left.withColumn("_home", home).withColumn("_b", F.explode(seen))
    ahead = Window.partitionBy(*key, "_b").orderBy("onset").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key, "_b").orderBy(F.desc("onset")).rowsBetween(Window.unboundedPreceding, -1)

    def other(best, w):
        mine = lambda ref: best(F.when(F.col("ref") == F.lit(ref), F.col("onset"))).over(w)
        return F.when(F.col("ref"), mine(False)).otherwise(mine(True))

    both = dealt.withColumn("_before", other(F.max, ahead)).withColumn("_after", other(F.min, after)).where("_b = _home")
    gone, come = F.col("onset") - F.col("_before"), F.col("_after") - F.col("onset")
    first = F.when(F.least(gone, come) <= reach, F.when(F.coalesce(gone <= come, come.isNull()), F.col("_before")).otherwise(F.col("_after")))
    out = both.withColumn("_o", first).where("_o IS NOT NULL")
    return out.select(*key, "onset", "ref", "n", F.when(F.col("ref"), F.col("onset")).otherwise(F.col("_o")).alias("reference"), F.when(F.col("ref"), F.col("_o")).otherwise(F.col("onset")).alias("predicted"))
