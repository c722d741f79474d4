"""Benchmark decontamination: a hash set of normalised test n-grams, looked up for each window of a document.

Everything is a built-in Spark expression.  The words of a document are hashed once; each window of
``n`` words is the hash of its word hashes, looked up in a literal set; hits are verified by their
words.  An item of fewer words than ``n`` is one window of its own length, so each such length that the
benchmark has costs one more pass over the word hashes.  The items of a hit come from a literal map of the windows.

A benchmark of more than MAX_LITERAL windows is a broadcast table of hashes instead, up to MAX_BROADCAST of them: only
the hashes of document windows meet it, only hits are shuffled, and they are verified by their words in the same way.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import once, spare

#: What separates words: every ASCII character but digits and lower-case letters, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Above so many windows the set is not a literal: the windows are then joined by their hash.
MAX_LITERAL = 200_000
#: Up to so many windows the join broadcasts them (some 200 MB); beyond, Spark chooses.
MAX_BROADCAST = 2_000_000
SLOTS = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _item_windows(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct (len, window, h, item): the windows of the items."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.lit(n), F.size("w")))
    w = w.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice(F.col("w"), i, F.col("len")))).alias("a"))
    return w.select("len", F.array_join("a", " ").alias("window"), F.xxhash64(F.transform("a", lambda x: F.xxhash64(x))).alias("h"), "item").distinct()


def _hits(df: DataFrame, windows: DataFrame, text_col: str, win_col: str) -> DataFrame:
    """df with n_words and win_col: an array of (at, len, window), the verified occurrences by their 1-based first word."""
    none = "CAST(array() AS array<struct<at: int, len: int, window: string>>)"
    windows = windows.select("len", "h", "window").distinct()
    per_len = {r["len"]: r["count"] for r in windows.groupBy("len").count().collect()}  # n rows at most
    at = {k: f"CASE WHEN size(h) >= {k} THEN sequence(1, size(h) - {k} + 1) ELSE CAST(array() AS array<int>) END" for k in per_len}
    literal = sum(per_len.values()) <= MAX_LITERAL
    (w_col,) = spare(df, "words_")
    df = once(df, **{w_col: words_of(F.col(text_col))})
    df = df.withColumn("n_words", F.size(w_col).cast("long"))
    if not per_len:
        return df.withColumn(win_col, F.expr(none)).drop(w_col)
    if literal:
        sets: dict[int, tuple[list, list]] = {k: ([], []) for k in per_len}
        for r in windows.collect():  # MAX_LITERAL rows at most
            sets[r["len"]][0].append(str(r["h"]))
            sets[r["len"]][1].append(f"'{r['window']}'")  # words hold no quote and no backslash
        parts = []
        for k, (hs, texts) in sorted(sets.items()):
            hashed = f"filter({at[k]}, i -> xxhash64(slice(h, i, {k})) IN ({','.join(hs)}))"
            shown = f"transform({hashed}, i -> struct(i AS at, {k} AS len, array_join(slice(`{w_col}`, i, {k}), ' ') AS window))"
            parts.append(f"filter({shown}, s -> s.window IN ({','.join(texts)}))")
        # the word hashes are bound once for all windows of the row
        return once(df, **{win_col: F.expr(f"transform(array(transform(`{w_col}`, x -> xxhash64(x))), h -> concat({', '.join(parts)}))[0]")}).drop(w_col)
    # beyond the bound of a literal: hashes of document windows join those of the benchmark; hits meet their text again
    key, k, found = spare(df, "text_key_", "key_", "found_")
    df = df.withColumn(key, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    each = ", ".join(f"transform({at[n]}, i -> struct(i AS at, {n} AS len, xxhash64(slice(h, i, {n})) AS h))" for n in sorted(per_len))
    rows = df.select(F.col(key).alias("k"), F.explode(F.expr(f"transform(array(transform(`{w_col}`, x -> xxhash64(x))), h -> concat({each}))[0]")).alias("s")).select("k", "s.*")
    rows = rows.join(F.broadcast(windows) if sum(per_len.values()) <= MAX_BROADCAST else windows, ["len", "h"]).select("k", "at", "len", "window").distinct()
    rows = rows.groupBy(F.col("k").alias(k)).agg(F.array_sort(F.collect_list(F.struct("at", "len", "window"))).alias(found))
    df = df.join(rows, df[key] == rows[k], "left")
    real = F.expr(f"filter(`{found}`, s -> s.window = array_join(slice(`{w_col}`, s.at, s.len), ' '))")
    return df.withColumn(win_col, F.coalesce(real, F.expr(none))).drop(key, k, found, w_col)


def mark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """docs with n_words and n_hit (long), contaminated (boolean) and hits, an array of (at, len, window):
    each occurrence of a window of an item, by its 1-based first word.

    A window is ``n`` consecutive words of an item, or all words of an item that has fewer.  Null texts and
    empty texts have no words and hit nothing; items without words have no window.  Repeated rows each get
    the same result.  Columns of docs with one of the new names are replaced, all others stay.  An empty
    benchmark leaves every document clean.  Up to MAX_LITERAL windows the documents are not shuffled.
    """
    windows = _item_windows(benchmark, item_col, item_text_col, n)
    df = _hits(docs, windows, text_col, "hits")
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    return df.withColumn("n_hit", F.when(F.size("hits") > 0, F.size(covered)).otherwise(0).cast("long")).withColumn("contaminated", F.size("hits") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """What mark() gives, with the items of the hits: n_items (long) and items (their ids as strings, sorted).

    Null item ids are no item, though their windows hit.  Up to MAX_LITERAL pairs of window and item the items are looked
    up in a literal; beyond, those of documents with hits are joined by the digest of their hits, and documents without
    hits have a key each, so that they don't meet in one task.
    """
    df = mark(docs, benchmark, text_col=text_col, item_col=item_col, item_text_col=item_text_col, n=n)
    df = df.drop(*[c for c in df.columns if c.lower() in ("n_items", "items")])
    none = F.expr("CAST(array() AS array<string>)")
    windows = _item_windows(benchmark, item_col, item_text_col, n).where("item IS NOT NULL").select("window", "item", F.expr(f"hash(window) & {SLOTS - 1}").alias("slot")).distinct()
    if windows.count() <= MAX_LITERAL:
        table: list[dict[str, list[str]]] = [{} for _ in range(SLOTS)]
        for r in windows.collect():  # MAX_LITERAL rows at most
            table[r["slot"]].setdefault(r["window"], []).append(r["item"])
        text = json.dumps(table, separators=(",", ":")).replace("\\", "\\\\").replace("'", "\\'")
        look = f"transform(array(from_json('{text}', 'array<map<string, array<string>>>')), t -> array_sort(array_distinct(flatten(transform(array_distinct(hits.window), w -> coalesce(t[hash(w) & {SLOTS - 1}][w], CAST(array() AS array<string>)))))))[0]"
        df = df.withColumn("items", F.when(F.size("hits") > 0, F.expr(look)).otherwise(none))
    else:
        key, k, window, found = spare(df, "hits_key_", "key_", "window_", "found_")
        digest = F.sha2(F.array_join(F.array_sort(F.array_distinct("hits.window")), "\n"), 256)
        df = df.withColumn(key, F.when(F.size("hits") > 0, digest).otherwise(F.concat(F.lit("clean "), F.xxhash64(id_col, text_col).cast("string"))))
        hit = df.where(F.size("hits") > 0).select(F.col(key).alias(k), F.explode(F.array_distinct("hits.window")).alias(window)).distinct()
        items = hit.join(windows, hit[window] == windows["window"]).groupBy(k).agg(F.array_sort(F.collect_set("item")).alias(found))
        df = df.join(items, df[key] == items[k], "left").withColumn("items", F.coalesce(F.col(found), none)).drop(key, k, found)
    return df.withColumn("n_items", F.size("items").cast("long"))
