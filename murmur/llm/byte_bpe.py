"""Byte-level BPE by folds of Spark's higher-order functions.

A text is split by the tokenizer's pattern.  A word that is a rank itself is one token.  Any other starts as the array of
its bytes, each as its rank, and a fold merges its adjacent pair of least rank, leftmost first, until no pair is in the rank
map.  The fold carries the ranks of the pairs along: a merge looks up the two pairs beside it and no others.

The words that take the most folding over all texts are folded once by Spark's functions, and with the words that are ranks
make a table of bounded size.  A task looks its texts' words up there by Arrow batches; the distinct words of a batch that the
table lacks are folded there by the same rule, on numpy arrays of ranks, a step for all of them at a time.  In Spark's fold
ranks are characters of a string, on which its functions are many times faster than on its arrays; its rank map is
an array of strings, chosen by a hash of the pair, as Spark searches a map from end to end, and tasks get it from a scalar
subquery.  Decoding concatenates the byte strings of the ids.  Documents are never shuffled, only counts of words.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm._common import materialise, once, release, ship, spare
from murmur.llm._words import buffers, give_back

PAIR_SLOTS = 1 << 15
SPACE = r"\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Words folded beforehand, at most (some 2 MB), and how often each occurs at least; the others are folded batch by batch.
COMMON, LEAST_COMMON = 1 << 16, 3
#: Words of a batch that are looked up and folded at a time, but for those of one text; bounds the temporaries to some 30 MB.
WORDS = 1 << 17


def java_pattern(pattern: str) -> str:
    """The pattern with white space spelled out as Unicode has it, which Java's \\s does not."""
    out, inside = [], False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            two = pattern[i : i + 2]
            out.append({r"\s": SPACE if inside else f"[{SPACE}]", r"\S": f"[^{SPACE}]"}.get(two, two))
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines with a byte string in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Code:
    """Ranks as characters, in the same order: of two or three bytes where all fit below the surrogates, else of four.
    none is the character that tells that a pair has no rank."""

    def __init__(self, ranks: dict[bytes, int]):
        most = max(ranks.values())
        self.first, self.none = (0x100, "\uffff") if most < 0xD800 - 0x100 else (0x10000, chr(0x10FFFF))
        if most >= ord(self.none) - self.first:
            raise ValueError("ranks below 2^20 - 1 only")

    def __call__(self, ids) -> str:
        return "".join(chr(self.first + i) for i in ids)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _slot(key: str, n: int) -> int:
    """Which of n slots, a power of two, the key falls into: as _slot_sql has it."""
    return zlib.crc32(key.encode()) & n - 1


def _slot_sql(key: str, n: int) -> str:
    return f"CAST(crc32(CAST({key} AS BINARY)) & {n - 1}L AS INT)"


def _bound(expr: str, **values: str) -> str:
    """expr with names bound to values: transform(array(x), y -> ...)[0] binds x to y."""
    for name, value in values.items():
        expr = f"transform(array({value}), {name} -> {expr})[0]"
    return expr


def _merges(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """The pairs of ranks whose byte strings together have one, and that."""
    return [(ranks[k[:i]], ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]


def _pairs(merges: list[tuple[int, int, int]], code: _Code) -> list[str]:
    """PAIR_SLOTS strings with the merges, each as the two characters of its pair, a bar, that of the merge, a bar; before them
    a bar and the character for none."""
    table = [f"|{code.none}"] * PAIR_SLOTS
    for a, b, r in merges:
        k = code((a, b))
        table[_slot(k, PAIR_SLOTS)] += f"{k}|{code([r])}|"
    return table


def _row(spark: SparkSession, values: list[str]) -> DataFrame:
    """A written table of one row, the array t of values."""
    one = pa.table({"t": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.string()))})
    return materialise(spark.createDataFrame(one, "t array<string>"), "array")


def _by(df: DataFrame, out_col: str, expr: str, v: DataFrame) -> DataFrame:
    """df with out_col, the SQL expression in which v is the array of the table v of one row, computed once a row.  The array is
    a scalar subquery: as a literal it stands in every text that Spark makes of a plan, megabytes each on the driver."""
    held, kept = spare(df, "held_", "kept_")
    # the one use of the column is where the optimiser puts the subquery, which may not be written there
    df = df.withColumn(held, v.scalar()).withColumn(kept, F.expr(_bound(expr, v=f"`{held}`"))).drop(held)
    return once(df, **{out_col: F.col(kept)}).drop(kept)


def _pair(key: str) -> str:
    """The character of the merge of the two in key, or the one for none: the second after the key in its slot, or of the
    whole slot where the key isn't found.  v is the array of pairs."""
    return f"substring(substring_index(v[{_slot_sql(key, PAIR_SLOTS)}], {key}, -1), 2, 1)"


class _Fold:
    """The fold over the bytes of a word w, as SQL: the characters of its ids."""

    def __init__(self, ranks: dict[bytes, int], code: _Code):
        start = f"struct(p AS p, array_join(IF(length(p) < 2, array(), transform(sequence(1, length(p) - 1), i -> {_pair('substring(p, i, 2)')})), '') AS r)"
        # m: the least rank of a pair, which is that of its merge; j: its place, from 1; q: what p becomes
        left = f"IF(j > 1, concat(substring(s.r, 1, j - 2), {_pair('substring(q, j - 1, 2)')}), '')"
        right = f"IF(j < length(q), concat({_pair('substring(q, j, 2)')}, substring(s.r, j + 2)), '')"
        merged = _bound(f"struct(q AS p, concat({left}, {right}) AS r)", q="concat(substring(s.p, 1, j - 1), m, substring(s.p, j + 2))")
        step = _bound(f"IF(m = '' OR m = '{code.none}', s, {_bound(merged, j='instr(s.r, m)')})", m="array_min(split(s.r, ''))")
        # the bytes as characters, then as those of their ranks
        names = "".join(map(chr, range(256)))
        split = f"translate(decode(encode(w, 'UTF-8'), 'ISO-8859-1'), {_quoted(names)}, '{code(ranks[bytes([b])] for b in range(256))}')"
        #: It refers to v, the array of pairs.
        self.expr = _bound(f"aggregate(sequence(1, greatest(length(p) - 1, 1)), {start}, (s, i) -> {step}, s -> s.p)", p=split)


def _whole(ranks: dict[bytes, int], code: _Code) -> dict[str, str]:
    """The words that are ranks; byte strings that are no text never are."""
    out = {}
    for k, r in ranks.items():
        try:
            out[k.decode()] = code([r])
        except UnicodeDecodeError:
            continue
    return out


def common_words(texts: DataFrame, text_col: str, pattern: str, most: int = COMMON) -> DataFrame:
    """(w, n): the words of all texts that take the most folding, by count and length, with their counts, ``most`` of them at most, LEAST_COMMON times each at least.

    Pieces between spaces are counted first and only those that repeat are split by the pattern, so the counts of words at the
    start of a text or beside other white space may be off; they only decide what is encoded beforehand.  Words of one
    byte are left out.  pattern is as SQL text."""
    piece = texts.select(F.explode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), " ")).alias("p")).groupBy("p").agg(F.count("*").alias("n")).where("n > 1")
    words = piece.select(F.explode(F.expr(f"regexp_extract_all(concat(' ', p), '{pattern}', 0)")).alias("w"), "n")
    words = words.where("octet_length(w) > 1").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COMMON)
    words = materialise(words.withColumn("g", F.floor(F.log2(F.col("n") * F.octet_length("w")) * 16)), "words")
    room, least = most, None
    for g, n in sorted(((r["g"], r["count"]) for r in words.groupBy("g").count().collect()), reverse=True):  # 1,000 rows at most
        if n > room:
            break
        room, least = room - n, g
    return words.where(F.lit(False) if least is None else F.col("g") >= least).select("w", "n")


class _Merges:
    """The fold over the bytes of many words at a time."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 1
        #: Stands for no rank, above all of them.
        self.none = self.base
        a, b, r = np.array(merges, np.int64).reshape(-1, 3).T
        by = np.argsort(a * self.base + b)
        self.keys, self.ranks = np.r_[(a * self.base + b)[by], -1], np.r_[r[by], self.none]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair."""
        key = a * self.base + b
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def fold(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has; text: their bytes, size: how many, none of them 0."""
        p, word, n = self.byte[text], np.arange(len(size)), len(size)
        r = np.r_[self.rank(p[:-1], p[1:]), self.none] if len(p) else p
        r[np.cumsum(size) - 1] = self.none
        ids, of = [p[:0]], [word[:0]]
        while len(size):
            m = np.minimum.reduceat(r, np.cumsum(size) - size)
            more = m < self.none
            if not more.all():  # words without a pair to merge are done
                left = np.repeat(more, size)
                ids.append(p[~left])
                of.append(np.repeat(word[~more], size[~more]))
                p, r, word, size, m = p[left], r[left], word[more], size[more], m[more]
            hit = np.flatnonzero(r == np.repeat(m, size))
            own = np.searchsorted(np.cumsum(size), hit, "right")
            at = hit[np.diff(own, prepend=-1) > 0]  # the leftmost of each word
            p[at] = m
            p, r = np.delete(p, at + 1), np.delete(r, at + 1)
            at, size = at - np.arange(len(at)), size - 1
            end = np.cumsum(size)
            to, since = at[at + 1 < end], at[at > end - size]
            r[at] = self.none
            r[to] = self.rank(p[to], p[to + 1])
            r[since - 1] = self.rank(p[since - 1], p[since])
        of = np.concatenate(of)
        return np.concatenate(ids)[np.argsort(of, kind="stable")], np.bincount(of, minlength=n)


class _Words:
    """Words and their ids, as a task looks them up."""

    def __init__(self, table: pa.Table, first: int, merges: _Merges):
        self.words = table["w"].combine_chunks().cast(pa.string())
        characters = table["p"].combine_chunks().cast(pa.string())
        self.size = pc.utf8_length(characters).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = np.frombuffer("".join(characters.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64) - first
        self.merges = merges

    def ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        gone = np.asarray(known.is_null().to_numpy(zero_copy_only=False), bool)
        text, offsets = buffers(coded.dictionary.filter(pa.array(gone)))
        new, many = self.merges.fold(text, np.diff(offsets))
        # each distinct word's place among those of the table and the new ones after them
        at = np.asarray(known.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        at[gone] = len(self.size) + np.arange(len(many))
        size, flat = np.r_[self.size, many], np.r_[self.flat, new]
        start = np.cumsum(size) - size
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        size, start = size[at], start[at]
        before = np.cumsum(size) - size
        return flat[np.arange(size.sum()) + np.repeat(start - before, size)].astype(np.int32), size

    def look(self, texts: pa.ListArray) -> pa.ListArray:
        """The ids of each text, given as its words."""
        offsets = texts.offsets.to_numpy().astype(np.int64)
        words = texts.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.string())
        offsets, ids, size, at = offsets - offsets[0], [], [], 0
        while at < len(words):
            to = int(max(offsets[np.searchsorted(offsets, at + WORDS, "right") - 1], offsets[np.searchsorted(offsets, at, "right")]))
            for x, part in zip((ids, size), self.ids(words.slice(at, to - at)), strict=True):
                x.append(part)
            at = to
        before = np.r_[0, np.cumsum(np.concatenate([*size, np.zeros(0, np.int64)]))]
        return pa.ListArray.from_arrays(pa.array(before[offsets].astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, *, text_col: str = "text", out_col: str = "ids", common: int = COMMON) -> DataFrame:
    """df with out_col, the array of token ids of each text; empty for null and empty texts.

    Each match of the pattern is encoded by itself; no special tokens.  A column of df named out_col is replaced, all
    others stay.  Every single byte must have a rank.  A word of n bytes takes n steps that each read up to n ranks.
    Repeated rows and equal texts each get their ids; no rows give no rows.  Up to ``common`` words are encoded
    beforehand, which takes a pass over the texts and changes no result; 0 for none.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte needs a rank")
    spark = df.sparkSession
    ship(spark)
    pattern = java_pattern(pattern).replace("\\", "\\\\").replace("'", "\\'")
    code, merges = _Code(ranks), _merges(ranks)
    whole = _whole(ranks, code)
    known = spark.createDataFrame(pa.table({"w": pa.array(list(whole), pa.string()), "p": pa.array(list(whole.values()), pa.string())}))
    if common:
        new = common_words(df, text_col, pattern, common).join(known, "w", "left_anti")
        known = known.union(_by(new, "p", _Fold(ranks, code).expr, _row(spark, _pairs(merges, code))).select("w", "p"))
    # ``common`` and the ranks, at most; ids stay characters, which take little room on the driver
    known = materialise(known, "words")
    release(spark)  # compiled classes and the texts of plans add up on the driver otherwise
    held = spark.sparkContext.broadcast((known.toArrow(), code.first, _Merges(ranks, merges)))

    @F.arrow_udf("array<int>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _Words(*held.value)
        for b in batches:
            yield words.look(b)
            give_back()

    split = F.expr(f"regexp_extract_all(coalesce(CAST(`{text_col}` AS STRING), ''), '{pattern}', 0)")
    return once(df, **{out_col: look(split)})


def decode(df: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col, the bytes of the ids in order, concatenated; empty for null and for no ids.

    An unknown id is an error.  A column of df named out_col is replaced, all others stay."""
    pieces: list[str] = [""] * (max(ranks.values(), default=-1) + 1)
    for k, r in ranks.items():
        pieces[r] = k.hex()
    joined = f"unhex(array_join(transform(coalesce(`{ids_col}`, CAST(array() AS ARRAY<INT>)), i -> v[i]), ''))"
    return _by(df, out_col, joined, _row(df.sparkSession, pieces))
