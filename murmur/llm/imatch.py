"""I-Match fingerprints with randomised lexicons.

The terms of a document that lie in a band of inverse document frequency are sorted by hash, made
distinct, and hashed once for each of several random subsets of that lexicon.  Two documents whose
terms in a subset agree have the same hash there, so the share of equal hashes tells how alike they are.

Everything is a built-in Spark expression.  Document frequencies are counted over all documents for each
term, known by 62 bits of its hash.  Up to MAX_LITERAL terms in the band are an array, in which the entries at three places
of a term make up its key, that tasks get as the value of a scalar subquery; beyond, the band is a table that terms are
joined with, which moves each term of each text.  A subset keeps the terms whose hash has a run of
zero bits at its own place: LEVELS rates (1/2, 1/8, ...) times SUBSETS places, so that texts of a few
words and of many thousands both have subsets which hold a few of their terms.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm._common import materialise, once, spare

#: Terms in the band that an array holds, 10 bytes a term; the band grows more slowly than the corpus.
MAX_LITERAL = 1 << 23
#: Bits by which a key is shifted for its place in each third of the array.
SHIFTS = (0, 21, 35)
#: Tasks that share the join of equal texts beyond MAX_LITERAL.
SHARES = 64
#: The band: idf as a share of its greatest value, ln N, for N documents.
IDF_LOW, IDF_HIGH = 0.25, 0.9
SUBSETS, LEVELS = 7, 5
MAX_BLOCKS = 1 << 16
#: Hex digits of a subset's hash in the fingerprint; a subset without terms shows as EMPTY.
DIGITS, EMPTY = 6, "......"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text: lower-cased runs of letters, digits and non-ASCII characters."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _key(h: Column) -> Column:
    """62 bits of a term's hash, the highest two set: 16 hex digits always, and never 0."""
    return h.bitwiseOR(F.lit(-(1 << 62)))


def lexicon(docs: DataFrame, text_col: str = "text", *, low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame | Table | None:
    """The keys of the terms whose document frequency over all docs is in the band: a Table for MAX_LITERAL keys at
    most, else a DataFrame (key).

    Null texts are documents without terms.  With no documents, or one, every term is in the band: None.
    """
    n = docs.count()
    if n < 2:
        return None
    least, most = n ** (1 - high), n ** (1 - low)
    terms = docs.select(F.explode(_hashes(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("h")).select(_key(F.col("h")).alias("key"))
    counts = materialise(terms.groupBy("key").count(), "terms")
    inside = F.col("count").between(math.ceil(least - 1e-9), math.floor(most + 1e-9))
    band = counts.where(inside).select("key")
    if band.count() > MAX_LITERAL:
        return materialise(band, "band")
    return Table(docs.sparkSession, band.toArrow()["key"].to_numpy().astype(np.int64))


class Table:
    """Distinct keys, none 0, in an array of some 1.23 longs a key: a key has a place in each third of it, and is held if the
    longs there, xored, are the key.  For another key they are so by chance only, as rarely as keys of 62 bits agree.  ``rows``
    is one row with the array t."""

    def __init__(self, spark: SparkSession, keys: np.ndarray):
        self.third = len(keys) * 41 // 100 + 32
        while (laid := self._laid(keys)) is None:
            self.third += self.third // 16 + 1
        one = pa.table({"t": pa.ListArray.from_arrays(pa.array([0, len(laid)], pa.int32()), pa.array(laid))})
        self.rows = materialise(spark.createDataFrame(one, "t array<bigint>"), "places")

    def _laid(self, keys: np.ndarray) -> np.ndarray | None:
        """Keys that have a place of their own are set aside, round by round, and laid in the opposite order; None if some stay."""
        size = len(SHIFTS) * self.third
        at = np.stack([(j * self.third + (keys >> shift) % self.third).astype(np.int32) for j, shift in enumerate(SHIFTS)])
        many, held = np.bincount(at.ravel(), minlength=size).astype(np.int32), np.zeros(size, np.int32)
        for places in at:
            np.bitwise_xor.at(held, places, np.arange(len(keys), dtype=np.int32))
        rounds, left = [], len(keys)
        alone = np.flatnonzero(many == 1)
        while len(alone):
            which, first = np.unique(held[alone], return_index=True)
            rounds.append((which, alone[first]))
            left -= len(which)
            for places in at:
                np.subtract.at(many, places[which], 1)
                np.bitwise_xor.at(held, places[which], which)
            alone = np.unique(at[:, which])
            alone = alone[many[alone] == 1]
        if left:
            return None
        table = np.zeros(size, np.int64)
        for which, place in reversed(rounds):
            table[place] = keys[which] ^ np.bitwise_xor.reduce(table[at[:, which]], axis=0)
        return table

    def holds(self, key: Column, table: Column) -> Column:
        """Whether the array holds a key of _key()."""
        one, two, three = (F.get(table, (F.pmod(F.shiftright(key, shift), F.lit(self.third)) + j * self.third).cast("int")) for j, shift in enumerate(SHIFTS))
        return one.bitwiseXOR(two).bitwiseXOR(three) == key


def with_fingerprint(df: DataFrame, text: Column, lex: DataFrame | Table | None, out_col: str, spread: Column | None = None) -> DataFrame:
    """df with out_col: SUBSETS * LEVELS hashes in one string.  Equal texts have equal fingerprints; a
    text without terms in the band, such as null or the empty text, shows EMPTY throughout.  ``spread`` is what deals equal
    texts to SHARES tasks where the band is joined, such as an id."""
    band, found = spare(df, "band_", "found_")
    df = once(df, **{band: _hashes(F.coalesce(text, F.lit("")))})
    if isinstance(lex, Table):
        # the one use of the column is where the optimiser puts the subquery, which may not be written there
        held, kept = spare(df, "held_", "kept_")
        inside = F.transform(F.array(held), lambda t: F.filter(band, lambda h: lex.holds(_key(h), t)))
        df = df.withColumn(held, lex.rows.scalar()).withColumn(kept, F.element_at(inside, 1)).drop(held, band)
        df = once(df, **{band: F.col(kept)}).drop(kept)
    elif lex is not None:
        one, two, share = spare(df, "one_", "two_", "share_")
        names = [one, two, share]
        df = df.withColumn(one, F.xxhash64(F.lit(1), text)).withColumn(two, F.xxhash64(F.lit(2), text)).withColumn(share, F.lit(0) if spread is None else F.pmod(F.xxhash64(spread), F.lit(SHARES)))
        terms = df.select(*names, F.explode(band).alias("h")).withColumn("key", _key(F.col("h"))).join(lex, "key", "left_semi")
        df = df.join(terms.groupBy(*names).agg(F.collect_set("h").alias(found)), names, "left").withColumn(band, F.coalesce(found, F.array().cast("array<bigint>"))).drop(*names, found)
    df = once(df, **{band: F.sort_array(band)})
    # per place k: the nested subsets of all levels, each the terms whose bits under the mask are zero;
    # transform(array(x), v -> ...)[0] binds x to v
    masks = ",".join(f"{_signed((1 << (2 * level + 1)) - 1 << 9 * k)}L" for k in range(SUBSETS) for level in range(LEVELS))
    digits = f"IF(size(a) = 0, '{EMPTY}', substring(hex(xxhash64(k, a) | {-(1 << 62)}L), 11, {DIGITS}))"
    step = f"transform(array(array({masks})[k * {LEVELS} + l]), m -> transform(array(filter(s.a, h -> (h & m) = 0L)), a -> struct(a AS a, concat(s.out, {digits}) AS out))[0])[0]"
    shown = f"array_join(transform(sequence(0, {SUBSETS - 1}), k -> aggregate(sequence(0, {LEVELS - 1}), struct(`{band}` AS a, '' AS out), (s, l) -> {step}, s -> s.out)), '')"
    return once(df, **{out_col: F.expr(shown)}).drop(band)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(a: str, b: str) -> Column:
    """How alike the fingerprints in two columns are, from 0 to 1: 1 if they are equal; else the share of equal
    hashes in the sparsest level where half of the subsets hold terms of either, or over all levels if none does."""
    part = lambda c: f"substring(`{c}`, i * {DIGITS} + 1, {DIGITS})"
    filled = f"filter(p, i -> {part(a)} <> '{EMPTY}' OR {part(b)} <> '{EMPTY}')"
    counts = lambda p: f"transform(array({filled.replace('filter(p', f'filter({p}')}), f -> struct(size(f) AS n, size(filter(f, i -> {part(a)} = {part(b)})) AS same))[0]"
    levels = f"transform(sequence(0, {LEVELS - 1}), l -> {counts(f'transform(sequence(0, {SUBSETS - 1}), k -> k * {LEVELS} + l)')})"
    best = f"element_at(concat(array({counts(f'sequence(0, {SUBSETS * LEVELS - 1})')}), filter({levels}, x -> x.n * 2 >= {SUBSETS})), -1)"
    return F.expr(f"CAST(IF(`{a}` = `{b}`, 1.0D, transform(array({best}), x -> IF(x.n = 0, 0.0D, x.same / x.n))[0]) AS DOUBLE)")


def next_rows(df: DataFrame, order_col: str, carry: list[str], *, per_block: int = 50_000, keys: DataFrame | None = None) -> DataFrame:
    """df with next_<c> for each carried column: its value in the next row by order_col (an integer column),
    ascending, nulls first, ties by the carried columns; after the last row comes the first.

    Rows are dealt to blocks between quantiles of order_col, so no task sees the whole order.  The rows that
    tie for the first of a block are dealt to the block before it as well, behind its own rows.  A table of
    one row is its own next row.  The driver holds one number a block, MAX_BLOCKS at most.  ``keys`` has the values of order_col
    that df has, as often: the blocks are found there, in three passes, where df takes work to compute.
    """
    keys = (df if keys is None else keys).select(order_col)
    n = keys.count()
    blocks = min(MAX_BLOCKS, max(n // per_block, min(n // 50, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))) or 1
    cuts = sorted(set(keys.approxQuantile(order_col, [k / blocks for k in range(1, blocks)], 0.2 / blocks))) if blocks > 1 else []
    block, spot = spare(df, "block_", "spot_")
    if cuts:
        # bisection: how many of the cuts the value reaches
        cut = f"array({','.join(f'{c!r}D' for c in cuts)})"
        step = f"IF(CAST(`{order_col}` AS DOUBLE) >= {cut}[div(s.lo + s.hi, 2)], struct(CAST(div(s.lo + s.hi, 2) + 1 AS INT) AS lo, s.hi AS hi), struct(s.lo AS lo, CAST(div(s.lo + s.hi, 2) AS INT) AS hi))"
        found = f"aggregate(sequence(0, {len(cuts).bit_length()}), struct(0 AS lo, {len(cuts)} AS hi), (s, i) -> IF(s.lo >= s.hi, s, {step}), s -> s.lo)"
        of = F.coalesce(F.expr(found.replace("div(s.lo + s.hi, 2)", "((s.lo + s.hi) DIV 2)")), F.lit(0))
    else:
        of = F.lit(0)
    df, keys = df.withColumn(block, of), keys.withColumn(block, of)
    first = F.min(F.struct(F.col(order_col).isNotNull().alias("some"), F.col(order_col).cast("long").alias("value"))).alias("first")
    heads = [(r[block], r["first"]["value"]) for r in keys.groupBy(block).agg(first).orderBy(block).collect()]
    if heads:
        value, before = ["NULL"] * (heads[-1][0] + 1), ["NULL"] * (heads[-1][0] + 1)
        for k, (b, v) in enumerate(heads):
            value[b], before[b] = "NULL" if v is None else f"{v}L", str(heads[k - 1][0])
        spots = f"IF(CAST(`{order_col}` AS BIGINT) <=> CAST(array({','.join(value)}) AS ARRAY<BIGINT>)[`{block}`], array(struct(`{block}` AS block, 0 AS ghost), struct(CAST(array({','.join(before)}) AS ARRAY<INT>)[`{block}`] AS block, 1 AS ghost)), array(struct(`{block}` AS block, 0 AS ghost)))"
        df = df.withColumn(spot, F.explode(F.expr(spots)))
    else:
        df = df.withColumn(spot, F.struct(F.lit(0).alias("block"), F.lit(0).alias("ghost")))
    w = Window.partitionBy(f"{spot}.block").orderBy(f"{spot}.ghost", F.col(order_col).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in carry])
    df = df.select("*", *[F.lead(F.struct(F.col(c).alias("v"))).over(w)["v"].alias(f"next_{c}") for c in carry])
    return df.where(F.col(f"{spot}.ghost") == 0).drop(block, spot)


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, in which the last quarter of the code points
    (rounded down) gives way to the first as many of the next document by id_col; after the last comes the first.

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts
    count as empty; equal texts have equal fingerprints; repeated rows are documents of their own, next to each
    other in the order; no documents give no rows.  Other columns of docs take no part.
    """
    lex = lexicon(docs, text_col, low=low, high=high)
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = with_fingerprint(df, F.col("text"), lex, "fingerprint", F.col(id_col))
    df = next_rows(df, id_col, ["text", "fingerprint"], keys=docs)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.left("text", n - quarter), F.left("next_text", quarter))).withColumn("n_chars", n.cast("long"))
    df = df.select(id_col, "n_chars", "edited", "fingerprint", "next_fingerprint")
    df = with_fingerprint(df, F.col("edited"), lex, "edited_fingerprint", F.col(id_col)).withColumn("edited_sha256", F.sha2("edited", 256))
    near = lambda c: likeness("fingerprint", c)
    return df.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
