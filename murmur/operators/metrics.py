"""Calibration, agreement, captions, distributions.  A measure with nothing to measure is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.scalars import col, ratio, split_list
from murmur.operators import matching
from murmur.operators.quantiles import percentiles
from murmur.sources.checkpoints import written


def reliability(df: DataFrame, prob: str, label: str, *, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """A row a bin (and group): n, mean_prob, mean_label.  Each sample is in one bin, 1.0 in the last; empty bins have n 0
    and null means."""
    by = by or []
    rows = df.withColumn("bin", F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int"))
    got = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("mean_label"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    spine = groups.withColumn("bin", F.explode(F.array(*[F.lit(i) for i in range(bins)])))
    return spine.join(got, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(df: DataFrame, prob: str, label: str, *, group: str, bins: int = 10) -> DataFrame:
    """(group, n, ece) for each group and, as group "pooled", over all samples in shared bins: one pass by grouping sets."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    rows = df.select(F.col(group).cast("string").alias("g"), b.alias("b"), F.col(prob).alias("p"), F.col(label).cast("double").alias("y"))
    sums = rows.groupingSets([["g", "b"], ["b"]], "g", "b").agg(F.grouping("g").alias("pooled"), F.count("*").alias("n"), F.abs(F.sum("p") - F.sum("y")).alias("gap"))
    named = sums.withColumn("group", F.when(F.col("pooled") == 1, "pooled").otherwise(F.col("g")))
    return named.groupBy("group").agg(F.sum("n").alias("n"), ratio(F.sum("gap"), F.sum("n")).alias("ece"))


def mean_measured(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: mean over its non-null values, n_measured, n_unmeasured; no values, no mean."""
    aggs = [e for c in columns for e in (F.avg(c).alias(f"{c}_m"), F.count(c).alias(f"{c}_n"), F.count_if(F.col(c).isNull()).alias(f"{c}_u"))]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_m").alias("mean"), F.col(f"{c}_n").alias("n_measured"), F.col(f"{c}_u").alias("n_unmeasured")) for c in columns])).alias("r")).select("r.*")


def caption_scores(df: DataFrame, said: str = "said", true: str = "true") -> DataFrame:
    """df with ehr, the share of said classes that are not true, and eor, the share of true ones not said."""
    p, g = F.array_distinct(said), F.array_distinct(true)
    return df.withColumn("ehr", ratio(F.size(F.array_except(p, g)), F.size(p))).withColumn("eor", ratio(F.size(F.array_except(g, p)), F.size(g)))


def lexicon_audit(df: DataFrame) -> DataFrame:
    """One row: precision, recall and share of exact rows, from lists of extracted, wrong and missing phrases."""
    n = {c: F.size(split_list(c)) for c in ("extracted", "wrong", "missing")}
    sums = df.agg(*[F.sum(e).alias(c) for c, e in n.items()], F.count("*").alias("rows"), F.count_if((n["wrong"] == 0) & (n["missing"] == 0)).alias("exact"))
    right = F.col("extracted") - F.col("wrong")
    return sums.select(ratio(right, "extracted").alias("precision"), ratio(right, right + F.col("missing")).alias("recall"), ratio("exact", "rows").alias("exact_rate"), "rows")


def precision_recall(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by group."""
    tp, fp, fn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual)
    c = df.groupBy(*(by or [])).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return c.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn"))).withColumn("f1", ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")))


def class_weights(df: DataFrame, group: str) -> DataFrame:
    """df with ``weight``: each group has the same total, all together 1."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    groups = counts.agg(F.count("*").alias("_g"))
    one = counts.withColumn("_k", F.lit(1)).join(groups.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return df.join(F.broadcast(one), group).withColumn("weight", F.lit(1.0) / (F.col("_g") * F.col("_n"))).drop("_n", "_g")


#: Values that one task puts in order, some tens of MB; more are cut into stretches.
FEW = 500_000


def _stretch(value: str, cuts: list[float]) -> Column:
    """How many of the cuts the value reaches, by halving."""
    if not cuts:
        return F.lit(0)

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(value) < F.lit(cuts[mid]), among(lo, mid)).otherwise(among(mid + 1, hi))

    return among(0, len(cuts))


def cumulative(rows: DataFrame, value: str, sums: list[str], by: list[str], *, stretches: int = 100, few: int = FEW) -> DataFrame:
    """rows with cum_<s>, the sum of s up to the row's value in its group, and all_<s>, the group's sum; a group has a
    value once.  Rows are written first.  More than ``few`` values are cut at their quantiles over all groups, and the sums of
    these stretches come first: a task puts about a hundredth of the values in order, whatever their spread."""
    rows = written(rows, "values")
    cuts = sorted(set(rows.approxQuantile(value, [k / stretches for k in range(1, stretches)], 0.25 / stretches))) if rows.count() > few else []
    cut = rows.withColumn("_s", _stretch(value, cuts))
    stretch = cut.groupBy(*by, "_s").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    order = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    before = stretch.select(*by, "_s", *[F.coalesce(F.sum(f"_{s}").over(order), F.lit(0)).alias(f"_b{s}") for s in sums], *[F.sum(f"_{s}").over(Window.partitionBy(*by)).alias(f"all_{s}") for s in sums])
    inner = Window.partitionBy(*by, "_s").orderBy(value)
    out = cut.join(before, [*by, "_s"])
    return out.select(*rows.columns, *[(F.sum(s).over(inner) + F.col(f"_b{s}")).alias(f"cum_{s}") for s in sums], *[f"all_{s}" for s in sums])


def weighted_percentiles(df: DataFrame, value: str, weight: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, share, value): the least value at which the weight so far reaches the share of all weight.  Equal values are
    summed before they are put in order."""
    by = by or []
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    so_far = cumulative(sums, value, ["w"], by).withColumnRenamed("cum_w", "_c").withColumnRenamed("all_w", "_t")
    picks = [F.min(F.when(F.col("_c") >= F.col("_t") * s - 1e-12, F.col(value))).alias(f"p{i}") for i, s in enumerate(shares)]
    wide = so_far.groupBy(*by).agg(*picks)
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"p{i}").alias("value")) for i, s in enumerate(shares)])).alias("r")).select(*by, "r.*")


def distribution(df: DataFrame, value: str, group: str, limits: tuple[float, ...]) -> DataFrame:
    """A row a group and one for all ("total"): n, p05, p50, p95, max and the share at or above each limit."""
    shares = [ratio(F.count_if(F.col(value) >= x), F.count("*")).alias(f"share_{i}") for i, x in enumerate(limits)]
    got = df.rollup(group).agg(F.grouping(group).alias("_t"), F.count("*").alias("n"), F.max(value).alias("max"), *shares)
    got = got.select(F.when(F.col("_t") == 1, "total").otherwise(F.col(group).cast("string")).alias("group"), "n", "max", *[f"share_{i}" for i in range(len(limits))])
    p = percentiles(df.select(F.col(group).cast("string").alias("group"), value), value, [0.05, 0.5, 0.95], ["group"])
    p = p.union(percentiles(df, value, [0.05, 0.5, 0.95]).select(F.lit("total"), "share", "value"))
    one = lambda s, name: F.max(F.when(F.col("share") == s, F.col("value"))).alias(name)
    p = p.groupBy(F.col("group").alias("g")).agg(one(0.05, "p05"), one(0.5, "p50"), one(0.95, "p95"))
    return got.join(p, F.col("group").eqNullSafe(F.col("g")), "left").select("group", "n", "p05", "p50", "p95", "max", *[f"share_{i}" for i in range(len(limits))])


def compared(df: DataFrame, side: str, group: str, value: str, shares: list[float]) -> DataFrame:
    """(share, synthetic, natural, uniform, delta): percentiles of the synthetic side, of the target as it is, and of the
    target with each group weighing the same; delta is synthetic less uniform."""
    s, t = df.where(F.col(side) == "synthetic"), df.where(F.col(side) == "target")
    one = lambda d, w, name: weighted_percentiles(d.withColumn("_w", w), value, "_w", shares).withColumnRenamed("value", name)
    out = one(s, F.lit(1.0), "synthetic").join(one(t, F.lit(1.0), "natural"), "share").join(one(class_weights(t, group), F.col("weight"), "uniform"), "share")
    return out.withColumn("delta", F.col("synthetic") - F.col("uniform"))


def ks(df: DataFrame, value: str, side: Column) -> DataFrame:
    """One row: n_a, n_b and the greatest gap of the two samples' distribution functions; side is true for the first."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    run = cumulative(c, "v", ["a", "b"], [])
    gap = F.max(F.abs(ratio("cum_a", "all_a") - ratio("cum_b", "all_b"))).alias("ks")
    return run.groupBy(F.col("all_a").alias("n_a"), F.col("all_b").alias("n_b")).agg(gap)


def greedy_pairs(reference: list[tuple[float, float]], predicted: list[tuple[float, float]], collar: float) -> list[tuple[int, int]]:
    """One-to-one pairs whose onsets lie within the collar, nearest first, then earliest."""
    near = sorted((abs(r[0] - p[0]), r[0], p[0], i, j) for i, r in enumerate(reference) for j, p in enumerate(predicted) if abs(r[0] - p[0]) <= collar + 1e-9)
    used_r, used_p, out = set(), set(), []
    for _, _, _, i, j in near:
        if i not in used_r and j not in used_p:
            used_r.add(i), used_p.add(j), out.append((i, j))
    return out


def event_counts(events: DataFrame, *, key: list[str], collar: float = 0.2) -> DataFrame:
    """(key, tp, fp, fn, shift) by clip and class from rows (key, side, onset, offset), side reference or predicted: pairs are
    one to one within the onset collar, nearest first, then earliest; shift is the sum of the pairs' onset differences."""
    pairs = matching.matched(events, key, collar=collar)
    hits = pairs.groupBy(*key).agg(F.sum("n").alias("tp"), F.sum(F.col("n") * (F.greatest("reference", "predicted") - F.least("reference", "predicted"))).alias("shift"))
    sizes = events.groupBy(*key).agg(F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "predicted").alias("p"))
    hits = hits.select(*[F.col(k).alias(f"_{k}") for k in key], "tp", "shift")
    both = sizes.join(hits, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    tp = F.coalesce("tp", F.lit(0)).cast("long")
    return both.select(*key, tp.alias("tp"), (F.col("p") - tp).alias("fp"), (F.col("r") - tp).alias("fn"), F.coalesce("shift", F.lit(0.0)).alias("shift"))


def f1(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, mean_shift summed over the groups."""
    c = counts.groupBy(*(by or [])).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("shift").alias("_s"))
    return c.select(*(by or []), "tp", "fp", "fn", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"), ratio("_s", "tp").alias("mean_shift"))


def sweep(df: DataFrame, prob: str, label: str, thresholds: list[float]) -> DataFrame:
    """A row a threshold: tp, fp, fn and f1 of prob >= threshold against a 0/1 label, with ``best`` on the greatest f1 (the
    least threshold of equals).  Samples are counted by the thresholds they pass, so no sample is repeated a threshold."""
    grid = sorted(thresholds)
    passed = F.aggregate(F.array(*[F.lit(t) for t in grid]), F.lit(0), lambda s, t: s + F.when(F.col(prob) >= t, 1).otherwise(0))
    hist = df.select(passed.alias("k"), (F.col(label) > 0).alias("y")).groupBy("k").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    every = hist.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    hit = F.col("k") > F.col("i")
    c = every.groupBy("i").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))
    c = c.select(F.array(*[F.lit(t) for t in grid])[F.col("i")].alias("threshold"), "tp", "fp", "fn", ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("f1"), "threshold"))  # a row a threshold
    return c.withColumn("best", rank == 1)


def fingerprint(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, digest): SHA-256 of the sorted labels of each key, equal for equal labels in any order."""
    return df.groupBy(*key).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(col(value).cast("string")))), 256).alias("digest"))


def gate(counts: DataFrame, shifts: DataFrame) -> DataFrame:
    """(f1, median_shift, passed): event F1 of 0.75 or more and a median onset shift of 0.1 s or less."""
    a = f1(counts).select("f1").withColumn("_k", F.lit(1))
    b = percentiles(shifts.select(F.abs("shift").alias("_s")), "_s", [0.5]).select(F.col("value").alias("median_shift"), F.lit(1).alias("_k"))
    return a.join(b, "_k", "left").select("f1", "median_shift", ((F.col("f1") >= 0.75) & (F.col("median_shift") <= 0.1)).alias("passed"))


