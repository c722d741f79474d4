"""Exact percentiles of groups by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.checkpoints import written

#: Distinct values of a group and rank that are put in order at last, by one task.
FEW = 4096
#: The rank error of the sketches that choose brackets is at most 1 / ACCURACY of a group.
ACCURACY = 1000


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, *, few: int = FEW) -> DataFrame:
    """(by, share, value): percentiles of the non-null values of each group, interpolated between neighbours in rank.

    All ranks of all groups are narrowed at once: sketches, which merge across tasks, give a bracket of values around each rank,
    one pass counts what lies below and inside, and that goes on inside the brackets until none holds more than ``few`` values
    between its ends.  Only those are then counted by value and put in order, so no task holds a group, and a bracket shrinks
    to some 4 of 1,000 of its rows each pass.  Null groups are a group; a group without values gives no row.
    """
    by = by or []
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    v, which = F.col("_v"), range(len(shares))
    state = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = state.select(*keys, "n", *[c for i, s in enumerate(shares) for c in (F.lit(float(s)).alias(f"s{i}"), (F.lit(float(s)) * (F.col("n") - 1)).alias(f"r{i}"), F.col("_lo").alias(f"a{i}"), F.col("_hi").alias(f"b{i}"), F.lit(0).cast("long").alias(f"under{i}"), F.col("n").alias(f"held{i}"), F.col("n").alias(f"open{i}"))])
    state = written(state, "ranks")
    while (state.agg(F.max(F.greatest(F.lit(0), *[f"open{i}" for i in which]))).first()[0] or 0) > few:
        state = written(_narrowed(rows, state, keys, len(shares), few), "ranks")
    near = _with_state(rows, state, keys)
    hit = F.explode(F.array_compact(F.array(*[F.when((v >= F.col(f"a{i}")) & (v <= F.col(f"b{i}")), F.lit(i)) for i in which]))).alias("_i")
    counts = near.select(*keys, "_v", hit).groupBy(*keys, "_i", "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "_i").orderBy("_v"))
    ranks = state.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"s{i}").alias("share"), F.col(f"r{i}").alias("r"), F.col(f"under{i}").alias("under")) for i in which])).alias("x")).select(*keys, "x.*")
    placed = _joined(counts.withColumn("c", upto), ranks, [*keys, "_i"])
    reach = lambda k: F.min(F.when(F.col("c") + F.col("under") > k, v))
    ends = placed.groupBy(*keys, "_i", "share", "r").agg(reach(F.floor("r")).alias("x"), reach(F.ceil("r")).alias("y"))
    ends = ends.withColumn("value", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.ceil("r") - F.col("r")) * F.col("x") + (F.col("r") - F.floor("r")) * F.col("y")))
    return ends.select(*by, "share", "value")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys meet."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys]
    return left.join(other, on).drop(*[f"_k_{k}" for k in keys])


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the brackets of their group: a row a group, of a single row where there are no groups."""
    return _joined(rows, F.broadcast(state) if keys == ["_all"] else state, keys)


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], k: int, few: int) -> DataFrame:
    """The state with narrower brackets: sketches of what each bracket with more than ``few`` open values holds, then a count of
    what is below and inside."""
    v = F.col("_v")
    inside = lambda i: (v >= F.col(f"a{i}")) & (v <= F.col(f"b{i}"))
    near = _with_state(rows, state, keys)
    grid = F.array(*[F.lit(x / ACCURACY) for x in range(ACCURACY + 1)])
    sketches = near.groupBy(*keys).agg(*[F.percentile_approx(F.when(inside(i) & (F.col(f"open{i}") > few), v), grid, F.lit(4 * ACCURACY)).alias(f"q{i}") for i in range(k)])
    at = _joined(state, sketches, keys)

    def bracket(i: int) -> tuple[Column, Column]:
        place = (F.col(f"r{i}") - F.col(f"under{i}")) / F.col(f"held{i}") * ACCURACY  # of the rank among what the bracket holds
        lo = F.get(f"q{i}", (F.floor(place) - 2).cast("int"))
        hi = F.get(f"q{i}", (F.ceil(place) + 2).cast("int"))
        done = F.col(f"open{i}") <= few
        return F.when(done, F.col(f"a{i}")).otherwise(F.coalesce(lo, F.col(f"a{i}"))), F.when(done, F.col(f"b{i}")).otherwise(F.coalesce(hi, F.col(f"b{i}")))

    pairs = [bracket(i) for i in range(k)]
    fixed = [c for i in range(k) for c in (f"s{i}", f"r{i}")]
    tight = written(at.select(*keys, "n", *fixed, *[c.alias(f"{n}{i}") for i, p in enumerate(pairs) for c, n in zip(p, "ab")]), "brackets")
    near = _with_state(rows, tight, keys)
    counted = near.groupBy(*keys).agg(*[c for i in range(k) for c in (F.count_if(v < F.col(f"a{i}")).alias(f"under{i}"), F.count_if(inside(i)).alias(f"held{i}"), F.count_if((v > F.col(f"a{i}")) & (v < F.col(f"b{i}"))).alias(f"open{i}"))])
    out = _joined(tight, counted, keys)
    # a bracket that missed its rank, against the sketch's promise, goes back to what it was and is narrowed no more
    was = state.select(*keys, *[F.col(f"{n}{i}").alias(f"{n}{i}_") for i in range(k) for n in ("a", "b", "under", "held")])
    kept = []
    for i in range(k):
        good = (F.col(f"under{i}") <= F.floor(f"r{i}")) & (F.col(f"under{i}") + F.col(f"held{i}") > F.ceil(f"r{i}"))
        kept += [F.when(good, F.col(f"{n}{i}")).otherwise(F.col(f"{n}{i}_")).alias(f"{n}{i}") for n in ("a", "b", "under", "held")]
        kept.append(F.when(good, F.col(f"open{i}")).otherwise(F.lit(0)).alias(f"open{i}"))
    return _joined(out, was, keys).select(*keys, "n", *fixed, *kept)
