"""Manifests: exclusions, seeds, splits, leakage, inventories, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.scalars import ratio
from murmur.operators.quantiles import percentiles


def merge_exclusions(kept: DataFrame, processed: DataFrame, rejects: DataFrame, stage: str) -> DataFrame:
    """The ledger after a stage: rows of that stage whose file was processed go, new rejects come."""
    gone = processed.select(F.col("file_id").alias("_f")).distinct()
    old = kept.join(gone, (F.col("file_id") == F.col("_f")) & (F.col("stage") == stage), "left_anti")
    return old.unionByName(rejects)


def absent(wanted: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows of wanted whose key is not present: what an idempotent seed adds."""
    return wanted.join(present.select(*key).distinct(), key, "left_anti")


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): keys that only one of two taxonomies has; none if they are equal."""
    ka, kb = a.select(*key).distinct(), b.select(*key).distinct()
    return ka.join(kb, key, "left_anti").withColumn("side", F.lit("a")).unionByName(kb.join(ka, key, "left_anti").withColumn("side", F.lit("b")))


def required(df: DataFrame, dim: DataFrame, key: str, what: str) -> DataFrame:
    """df joined with a dimension; a key without a row there is an error that names it, never a row lost."""
    d = dim.withColumn("_known", F.lit(True))
    out = df.join(F.broadcast(d), key, "left")
    return out.withColumn("_known", F.when(F.col("_known"), True).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))).where("_known").drop("_known")


def eligible(df: DataFrame, rules: DataFrame, source: str, split: str) -> DataFrame:
    """The rows whose split their source may be used in, by rules (source, splits array); a source without a rule is an error."""
    held = rules.select(F.col("source").alias("_source"), F.col("splits").alias("_splits"))
    missing = F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(F.col(source).cast("string"), F.lit("null"))))
    # the error is part of the condition, so that no filter can run ahead of it
    fits = F.when(F.col("_source").isNotNull(), F.array_contains("_splits", F.col(split))).otherwise(missing.cast("boolean"))
    return df.join(held, F.col(source) == F.col("_source"), "left").where(fits).drop("_source", "_splits")


def unmapped(names: DataFrame, mapping: DataFrame, name: str) -> DataFrame:
    """(name, n): names of a second annotation pass that the mapping lacks, with how many rows bear them; a null name is one."""
    seen = names.groupBy(name).agg(F.count("*").alias("n"))
    known = mapping.select(F.col(name).alias("_known")).distinct()
    return seen.join(known, F.col(name).eqNullSafe(F.col("_known")), "left_anti")


def leaked(df: DataFrame, source: str, split: str) -> DataFrame:
    """(source, n_splits) for sources found in more than one split."""
    return df.select(source, split).distinct().groupBy(source).agg(F.count("*").alias("n_splits")).where("n_splits > 1")


def shared_sources(df: DataFrame, source: str, split: str, a, b) -> DataFrame:
    """One row: distinct sources of a, of b, of both, and the share of a's that b has."""
    per = df.groupBy(source).agg(F.bool_or(F.col(split) == a).alias("a"), F.bool_or(F.col(split) == b).alias("b"))
    n = per.agg(F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))
    return n.withColumn("ratio", ratio("n_both", "n_a"))


def group_split(df: DataFrame, group: str, parts: list[tuple[str, float]], seed: str) -> DataFrame:
    """df with ``split``: all rows of a group in one part, by a seeded hash of the group, with the given shares."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1_000_000)) / 1e6
    out, upto = None, 0.0
    for name, share in parts[:-1]:
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return df.withColumn("split", out.otherwise(parts[-1][0]) if out is not None else F.lit(parts[-1][0]))


def random_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with ``validation``: true for max(1, round(n * share)) rows, those of the least seeded hash of a key that has no
    equal; of equal hashes those of the least keys.

    The hash is that of seed and key as text, so other engines draw the same rows.  Rows are counted by its first 16 bits,
    65,536 numbers that the driver sees; all rows below the last of these bins are taken as they are, and only that bin is put
    in order.
    """
    draw = lambda c: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")), 256), 1, 15), 16, 10).cast("long")
    rows = df.withColumn("_b", F.shiftright(draw(key), 44))
    bins = sorted((r["_b"], r["count"]) for r in rows.groupBy("_b").count().collect())
    m, below = max(1, round(sum(c for _, c in bins) * share)), 0
    for last, c in bins:
        if below + c >= m:
            break
        below += c
    else:
        return df.withColumn("validation", F.lit(bool(bins)))
    edge = rows.where(F.col("_b") == last).select(F.col(key).alias("_p")).orderBy(draw("_p"), "_p").limit(m - below)
    edge = edge.withColumn("_e", F.lit(True))
    out = rows.join(edge, (F.col(key) == F.col("_p")) & (F.col("_b") == last), "left")
    return out.withColumn("validation", (F.col("_b") < last) | F.coalesce("_e", F.lit(False))).drop("_b", "_p", "_e")


def inventory(clips: DataFrame, targets: DataFrame, *, key: str = "class_id", duration: str = "duration_bank", source: str = "source_dataset") -> DataFrame:
    """A row a class of targets (key, target, least): n, minutes, sources (sorted), status ok / short / missing; classes
    without clips stay with 0, and a target of 0 has no status."""
    got = clips.groupBy(key).agg(F.count("*").alias("n"), (F.sum(duration) / 60).alias("minutes"), F.array_sort(F.collect_set(source)).alias("sources"))
    df = targets.join(got, key, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("minutes", F.coalesce("minutes", F.lit(0.0))).withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    status = F.when(F.col("target") == 0, F.lit(None)).when(F.col("n") >= F.col("target"), "ok").when(F.col("n") >= F.col("least"), "short").otherwise("missing")
    return df.withColumn("status", status)


def slice_summary(index: DataFrame, seconds: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(one row: clips, hours, silent), (slice, n): a clip counts in each of its slices."""
    one = index.agg(F.count("*").alias("clips"), F.round(F.count("*") * seconds / 3600, 1).alias("hours"), F.count_if(F.col("n_events") == 0).alias("silent"))
    return one, index.select(F.explode_outer("slices").alias("slice")).where("slice IS NOT NULL").groupBy("slice").agg(F.count("*").alias("n"))


def quality_reasons(*, duration="duration", clipped="clipped_ratio", rms="rms", rate="sample_rate") -> Column:
    """Reason codes of the technical gates; an empty array passes.  clipping_review is a flag, not a rejection."""
    d, c = F.col(duration), F.col(clipped)
    return F.array_compact(F.array(F.when(d < 0.1, "too_short"), F.when(d > 30, "too_long"), F.when(c > 0.01, "clipped"), F.when((c > 0.001) & (c <= 0.01), "clipping_review"), F.when(F.col(rms) < 0.001, "silent"), F.when(F.col(rate) < 16000, "low_sample_rate")))


def contamination(frames: DataFrame, clips: DataFrame, *, threshold: float = 0.15) -> DataFrame:
    """(clip, class_id, prob, verdict): the most probable alerting class of any frame; "" and 0.0 for clean clips and for
    clips without frames.  Only a probability above the threshold flags."""
    best = frames.groupBy("clip").agg(F.max_by("class_id", F.struct("prob", F.col("class_id"))).alias("c"), F.max("prob").alias("p"))
    flagged = F.coalesce(F.col("p") > threshold, F.lit(False))
    return clips.join(best, "clip", "left").select("clip", F.when(flagged, F.col("c")).otherwise("").alias("class_id"), F.when(flagged, F.col("p")).otherwise(0.0).alias("prob"), F.when(flagged, "flagged").otherwise("clean").alias("verdict"))


def overflow(df: DataFrame, offset: str, duration: str, name: str) -> DataFrame:
    """One row: n intervals that end after their clip, the worst excess and the clip it is in."""
    over = F.col(offset) - F.col(duration)
    return df.where(over > 0).agg(F.count("*").alias("n"), F.max(over).alias("worst"), F.max_by(name, F.struct(over, F.col(name))).alias("worst_name"))


def long_event_classes(bank: DataFrame, target: DataFrame, threshold: float, least_clips: int = 8) -> DataFrame:
    """Classes with least_clips bank clips, and one target event, of the threshold's length or more."""
    b = bank.where(F.col("eff") >= threshold).groupBy("class_id").agg(F.count("*").alias("n_bank")).where(F.col("n_bank") >= least_clips)
    return b.join(target.where(F.col("duration") >= threshold).groupBy("class_id").agg(F.count("*").alias("n_target")), "class_id")


def bank_summary(bank: DataFrame, cutoffs: tuple[float, ...] = (2.0, 4.0, 8.0)) -> DataFrame:
    """One row of the bank without its error rows: percentiles of effective and leading time, and clips and classes at each cutoff."""
    ok = bank.where((F.coalesce("loi", F.lit("")) == ""))
    aggs = [F.count("*").alias("n"), F.max("eff").alias("eff_max"), F.count_if(F.col("lead") > 0.5).alias("late")]
    aggs += [x for i, c in enumerate(cutoffs) for x in (F.count_if(F.col("eff") >= c).alias(f"n_{i}"), F.countDistinct(F.when(F.col("eff") >= c, F.col("class_id"))).alias(f"classes_{i}"))]
    out = ok.agg(*aggs)
    for name, shares in (("eff", [0.1, 0.5, 0.9]), ("lead", [0.5, 0.9])):
        rows = percentiles(ok, name, shares).agg(F.array_sort(F.collect_list(F.struct("share", "value"))).alias("p"))  # a row a share
        out = out.join(F.broadcast(rows.select(F.when(F.size("p") > 0, F.transform("p", lambda x: x["value"])).alias(name))), F.lit(True))  # one row each
    return out


def gathered(base: DataFrame, parts: dict[str, DataFrame], key: str = "run") -> DataFrame:
    """Runs with what each part knows of them; what is missing is null, never 0."""
    for name, p in parts.items():
        base = base.join(p.select(key, *[F.col(c).alias(f"{name}_{c}") for c in p.columns if c != key]), key, "full_outer")
    return base


def trained(manifest: DataFrame, expected: int) -> DataFrame:
    """df with ``complete``: as many epochs as expected or more; no epochs is not complete."""
    return manifest.withColumn("complete", F.coalesce(F.size("epochs") >= expected, F.lit(False)))
