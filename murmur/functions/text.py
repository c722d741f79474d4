"""Captions, documents for retrieval, answers, and phrase matching."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import vocabulary as V
from murmur.functions.scalars import capitalise, col, local_time, named, natural_join, part_of_day


def _ordered(items) -> Column:
    """Detections by onset; those of equal onset in their given order."""
    placed = F.transform(col(items), lambda x, i: F.struct(x["onset"].alias("onset"), i.alias("i"), x["offset"].alias("offset"), x["class_id"].alias("class_id")))
    return F.array_sort(placed)


def captions(df: DataFrame, items: str = "detections") -> DataFrame:
    """df with caption_en and caption_vi from an array of (class_id, onset, offset): none, one, at the same time, or in
    turn.  Whether the first two overlap decides between the last two.  A null array counts as empty."""
    d = F.coalesce(_ordered(items), F.array().cast("array<struct<onset: double, i: int, offset: double, class_id: string>>"))
    df = df.withColumn("_d", d)
    together = (F.col("_d")[0]["onset"] < F.col("_d")[1]["offset"]) & (F.col("_d")[1]["onset"] < F.col("_d")[0]["offset"])
    n = F.size("_d")
    rest = lambda a: F.slice(a, 2, F.greatest(F.lit(1), n - 1))
    df = df.withColumn("_en", _names(V.CLASS_EN)).withColumn("_vi", _names(V.CLASS_VI))
    a, b = F.col("_en"), F.col("_vi")
    english = F.when(n == 0, V.NO_EVENT_EN).when(n == 1, F.concat(capitalise(a[0]), F.lit(" is heard."))).when(together, F.concat(capitalise(natural_join(a, "and")), F.lit(" are heard at the same time."))).otherwise(F.concat(capitalise(a[0]), F.lit(" is followed by "), natural_join(rest(a), "and"), F.lit(".")))
    vietnamese = F.when(n == 0, V.NO_EVENT_VI).when(n == 1, F.concat(F.lit("Nghe thấy "), b[0], F.lit("."))).when(together, F.concat(F.lit("Nghe thấy "), natural_join(b, "và"), F.lit(" cùng lúc."))).otherwise(F.concat(F.lit("Nghe thấy "), b[0], F.lit(", sau đó là "), natural_join(rest(b), "và"), F.lit(".")))
    return df.withColumn("caption_en", english).withColumn("caption_vi", vietnamese).drop("_d", "_en", "_vi")


def _names(names: dict[str, str]) -> Column:
    return F.transform("_d", lambda x: named(x["class_id"], names))


def document(caption="caption_vi", classes="class_ids", start="window_start", location="location", area="area_type", severity_="severity") -> Column:
    """The text that stands for an event in retrieval: class names and ids, caption, place, local time, severity, a line each."""
    names = F.array_join(F.transform(col(classes), lambda c: named(c, V.CLASS_VI)), ", ")
    some = F.size(col(classes)) > 0
    local = local_time(start)
    place = F.when(F.coalesce(col(location), F.lit("")) != "", F.concat(col(location), F.when(F.coalesce(col(area), F.lit("")) != "", F.concat(F.lit(" ("), named(area, V.AREA_TYPE_VI), F.lit(")"))).otherwise("")))
    when_ = F.concat(F.date_format(local, "HH:mm"), F.lit(" ngày "), F.date_format(local, "dd/MM/yyyy"), F.lit(", "), part_of_day(F.hour(local)))
    level = F.when(F.coalesce(col(severity_), F.lit("")) != "", F.concat(F.lit("mức "), named(severity_, V.SEVERITY_VI)))
    lines = F.array(F.when(some, names).otherwise(V.NO_CLASS_VI), F.when(some, F.array_join(col(classes), ", ")), col(caption), place, when_, level)
    return F.array_join(F.array_compact(lines), "\n")


def answers(found: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, answer): the retrieved events as a list, most similar first; a fixed refusal where nothing was found."""
    local = local_time("window_start")
    line = F.concat(F.lit("- "), F.date_format(local, "HH:mm"), F.lit(" ngày "), F.date_format(local, "dd/MM/yyyy"), F.lit(": "), F.col("caption_vi"), F.lit(" (mức "), named("severity", V.SEVERITY_VI), F.lit(", "), F.col("event_id"), F.lit(")"))
    rows = found.select(key, F.struct((-F.col("similarity")).alias("s"), F.col("event_id").alias("e"), line.alias("line")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    text = F.concat(F.lit("Tìm thấy "), F.size("r").cast("string"), F.lit(" sự kiện liên quan:\n"), F.array_join(F.col("r.line"), "\n"))
    return questions.select(key).join(rows, key, "left").select(key, F.coalesce(text, F.lit(V.NO_EVIDENCE_VI)).alias("answer"))


def _lower(text) -> Column:
    """Lower case, letter by letter: a dotted capital I stays one letter, so a word with one stays whole."""
    return F.lower(F.translate(col(text), "\u0130", "i"))


def tokens(text, apart: bool = True) -> Column:
    """Lower-cased words; an apostrophe ending in n't counts as a word of its own, unless ``apart`` is false."""
    low = _lower(F.coalesce(col(text), F.lit("")))
    return F.filter(F.split(F.regexp_replace(low, "n't", " n't") if apart else low, r"[^\p{L}\p{N}']+"), lambda w: w != "")


def phrase_matches(texts: DataFrame, lexicon: DataFrame, *, key: str, text: str = "text", lang: str = "en", window: int = V.NEGATION_WINDOW) -> DataFrame:
    """(key, class_id, n): occurrences of the phrases of each class that no negation precedes within the window.  A window of 0
    counts every occurrence, and n't stays part of its word.

    A phrase matches on whole words, in any case.  Words are exploded with their positions once, phrases meet them by
    their first word, and the rest of a phrase is compared in place: no text is compared with every phrase.
    """
    phrases = lexicon.where(F.col("lang") == lang).select("class_id", tokens("phrase", window > 0).alias("p")).where(F.size("p") > 0).withColumn("first", F.col("p")[0])
    rows = phrases.select("first", F.size("p").alias("n")).collect()  # a lexicon is a small dimension
    firsts, longest = sorted({r["first"] for r in rows}), max((r["n"] for r in rows), default=1)
    negated = [n.split() for n in V.NEGATIONS[lang]]
    # places of first words are found in the text's array, so only they leave it, each with the few words around it
    around = lambda w, i: F.struct(F.get(w, i).alias("first"), F.slice(w, i + 1, F.lit(longest)).alias("ahead"), F.slice(w, F.greatest(F.lit(1), i + 1 - window), F.least(i, F.lit(window))).alias("before"))
    begins = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(firsts))
    some = lambda w: F.when(F.size(w) > 0, F.transform(begins(w), lambda i: around(w, i)))
    seen = texts.where(_lower(text).rlike("|".join(re.escape(f) for f in firsts)) if firsts else F.lit(False))
    words = seen.select(key, F.explode(F.element_at(F.transform(F.array(tokens(text, window > 0)), some), 1)).alias("x")).select(key, "x.*")
    hits = words.join(F.broadcast(phrases), "first").where(F.slice("ahead", F.lit(1), F.size("p")) == F.col("p"))
    before = F.col("before")
    said = F.concat(F.lit(" "), F.array_join(before, " "), F.lit(" "))
    no = F.lit(False)
    for n in negated if window > 0 else []:
        no = no | F.contains(said, F.lit(f" {' '.join(n)} "))
    return hits.where(~no).groupBy(key, "class_id").agg(F.count("*").alias("n"))


def alike(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(a, b, jaccard) of pairs with a < b whose sets of lower-cased words have a Jaccard similarity of ``least`` or more.

    The rarest words of each set come first, and of n words only the first n - ceil(least * n) + 1 seek partners: two sets that
    are alike share one of these, so common words join nothing.  Candidates are verified on their whole sets."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    sets = df.select(F.col(key).alias("k"), words.alias("w")).where(F.size("w") > 0)
    each = sets.select("k", F.explode("w").alias("x"))
    count = each.groupBy("x").agg(F.count("*").alias("n"))
    ranked = each.join(count, "x").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s"))  # a text's own words
    size = F.size("s")
    prefix = ranked.select("k", F.explode(F.slice("s", F.lit(1), (size - F.ceil(size * least - 1e-9) + 1).cast("int"))).alias("p")).select("k", "p.x")
    pairs = prefix.select(F.col("k").alias("a"), "x").join(prefix.select(F.col("k").alias("b"), "x"), "x").where("a < b").select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("k").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    score = shared / (F.size("wa") + F.size("wb") - shared)
    return both.select("a", "b", score.alias("jaccard")).where(F.col("jaccard") >= least)
