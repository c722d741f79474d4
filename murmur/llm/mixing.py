"""Mix sources to target weights, word for word: hash-random keys, sorted ranges, distributed prefix sums, exact cuts.

A source's target is its share by weight of all words, but at most ``epochs`` times its own words; what is over goes to the
other sources by weight until none is above.  That level is found from the sources in order of limit over weight: with the
sums of limits and weights before a source it follows whether the source reaches its limit, so no rounds are needed.

Defined cases: a null text has no words; a null source is a source like any other, the last one; a source without words has
the target 0; repeated rows and doc_ids count each for itself, and rows that tie in key, id and size are alike; no documents
give no rows.  Columns of the input whose names clash with the output's are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import materialise
from murmur.llm._order import ranked

WORD = r"[^\x20\x09-\x0D]+"


def cycle(place: Column, weights: tuple[int, ...]) -> Column:
    """The weights in turn by the source's place, from 0."""
    return F.array(*[F.lit(w).cast("long") for w in weights])[F.pmod(place, F.lit(len(weights))).cast("int")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), *, share: float = 1.0, epochs: int = 3) -> DataFrame:
    """(key, size, weight, target) from sizes (key, size), a row a source: targets add up to share of all sizes, share being
    epochs at most, and none is above epochs times its size.  Weights are dealt in turn by the order of keys."""
    if not 0 <= share <= epochs:
        raise ValueError("the share lies between 0 and the epochs")
    one = sizes.select(F.lit(0).alias("all_"), "key", "size")
    weighed = ranked(one, "all_", ["key"], name="sources").select("all_", "key", "size", cycle(F.col("place"), weights).alias("weight"))
    weighed = weighed.withColumn("limit_", F.col("size") * epochs).withColumn("ratio_", F.col("limit_") / F.col("weight"))
    rows = ranked(weighed, "all_", ["ratio_", "key"], ["limit_", "weight"], name="sources")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(1)).alias("w")).first()
    level = (F.lit(float(total["s"])) * share - F.col("before_limit_")) / (F.lit(total["w"]) - F.col("before_weight"))
    rows = rows.withColumn("level_", level).withColumn("full_", F.col("ratio_") <= F.col("level_"))
    rest = rows.where(~F.col("full_")).agg(F.min_by("level_", F.struct("ratio_", "key")).alias("l")).first()["l"]
    target = F.when(F.col("full_"), F.col("limit_").cast("double")).otherwise(F.lit(rest) * F.col("weight"))
    return rows.select("key", "size", "weight", target.alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, epochs: int = 3, seed: int = 0) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document: how many of its words the mix takes.

    A source takes as many whole epochs as its target holds, and of the next one the documents first in the order of their
    hash-random keys, the last of them in part, so that its words come to the target rounded to a word.  A document is taken
    epochs times at most.  Keys depend on id and seed alone, so reruns agree.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))  # null last
    draw = F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), F.lit(16))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(key.alias("key"), draw.alias("draw"), F.col(id_col).alias("id_"), F.col(source_col).alias("source_"), size.alias("size"))
    rows = ranked(slim, "key", ["draw", "id_", "size"], ["size"], name="mix")
    by = targets(materialise(rows.groupBy("key").agg(F.sum("size").alias("size")), "sources"), weights, share=share, epochs=epochs)
    by = by.select(F.col("key"), F.col("size").alias("source_size"), "target", F.round("target").cast("long").alias("budget"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("budget") - F.col("whole") * F.col("source_size") - F.col("before_size")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    out = rows.join(by, "key").withColumn("whole", whole)
    return out.select(F.col("id_").alias(id_col), F.col("source_").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"))
