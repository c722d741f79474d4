"""N-gram Jaccard join by prefix filtering under several global token orders.

A token is a hashed word n-gram.  Sets of sizes n whose Jaccard similarity reaches t must share l tokens
among the first n - ceil(t n) + l tokens of each, under any global order and for any l, as the first l that they share stand
there in both; l is 1 for short sets and grows with their size, since long prefixes meet by chance.  Here several orders are used:
all put tokens by how common they are (counted over all documents, for the most common ones), rare ones first,
and break ties by different hashes.  A pair is a candidate only if it shares prefix so many prefix tokens under
every order, and only candidates are verified, on their whole sets.  The orders are taken one after the other: only
documents that have a partner under one order send their prefixes under the next.

Copies: documents with equal sets are one class, found by a hash of the set, and take part once.  Groups of
documents that share a token are streamed in sorted order: small ones give their pairs, large ones are
chained by size, which keeps every pair of like sizes connected.  The connected candidates are verified in
blocks of bounded size, so near copies of one text are never spelled out as pairs.  A component beyond one block is
cut into bands of set sizes, so wide that documents two bands apart are never alike, and each band into blocks: a
block meets the blocks of its own band and of the next one.  Texts travel compressed, those of components beyond one
block as what they differ by from the text of their component's first class, and sets are made again from them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import materialise, release, ship, spare
from murmur.llm._words import U, buffers, give_back, hashes, mix, signed, sliced, windows
from murmur.llm.components import connected_components

ORDERS = 2
#: Tokens whose counts the orders tell apart, at most; all others count as rare.
COMMON = 1 << 18
LEAST_COMMON = 8
#: Tokens counted at a time in a task (some 60 MB).
COUNTED = 1 << 21
#: A set of n tokens shares 1 + n // PER_SHARED prefix tokens with one that is alike and no smaller.
PER_SHARED = 150
#: Documents that share a prefix token: up to so many give their pairs, more are chained.
SMALL = 32
#: Documents and tokens of one verification, at most, but for a single document of more.
BLOCK, TOKENS = 1024, 1 << 21
#: Bytes of first texts of components that are broadcast, at most; beyond, they are joined.
BASES = 32 << 20
#: Ids to drop that are broadcast, at most (some 64 MB); beyond, the rows are shuffled by id.
MAX_BROADCAST = 1_000_000
#: Bits of the filter on the second reading of the candidates' sets, at most.
FILTER_BITS = 1 << 26


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k consecutive words, or all words if there are fewer."""
    h, rows = hashes(*buffers(texts))
    grams = windows(h, k)
    out = []
    for a, z in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(grams[a : z - k + 1]))
        else:
            out.append(windows(h[a:z], z - a, seed=z - a) if z > a else h[:0])
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(signed(mix(np.array([mix(s).sum(dtype=U) ^ U(len(s))], U)))[0])


class Order:
    """How common the common tokens are: sorted tokens with a logarithm of their counts; all others are rare."""

    def __init__(self, tokens: np.ndarray, grade: np.ndarray):
        self.tokens, self.grade = tokens, grade

    def grades(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), U)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.grade[at], 0).astype(U)


def _prefix(s: np.ndarray, grades: np.ndarray, order: int, t: Fraction) -> np.ndarray:
    n = len(s)
    p = n - math.ceil(t * n) + 1 + n // PER_SHARED
    if p >= n:
        return s
    rank = (grades << U(56)) | (mix(s + U(order + 1)) >> U(8))
    return s[np.argpartition(rank, p - 1)[:p]]


def _order(docs: DataFrame, k: int) -> Order:
    """The common tokens over all docs, COMMON of them at most: those that several documents of a stretch of COUNTED tokens
    share, counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        fresh, held = [], 0
        for b in _then_none(sliced(batches, 1000)):
            for s in shingle_sets(b.column(0), k) if b is not None else ():
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    fresh.append(s)
                    held += len(s)
            if fresh and (b is None or held >= COUNTED):
                x, n = np.unique(np.concatenate(fresh), return_counts=True)
                some = n > 1
                yield pa.record_batch([pa.array(signed(x[some])), pa.array(n[some])], ["token", "n"])
                fresh, held = [], 0

    counts = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(F.col("n") >= LEAST_COMMON).withColumn("g", F.least(F.lit(255), F.floor(F.log2("n") * 4)).cast("int")), "tokens")
    by_grade = sorted(((r["g"], r["count"]) for r in counts.groupBy("g").count().collect()), reverse=True)  # 255 rows at most
    room, least = COMMON, 256
    for g, n in by_grade:
        if n > room:
            break
        room, least = room - n, g
    got = counts.where(F.col("g") >= least).select("token", "g").toArrow()
    tokens = np.asarray(got["token"].to_pylist(), np.int64).view(U)
    place = np.argsort(tokens)
    return Order(tokens[place], np.asarray(got["g"].to_pylist(), np.uint8)[place])


def _prefixes(docs: DataFrame, k: int, t: Fraction, common, order: int, some) -> DataFrame:
    """(token, cls, n): the prefix tokens of each set under an order, which is in the token's low bits; of the classes in
    the filter ``some``, a broadcast of words and bits, or of all if it is None."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches, 1000):
            tokens, names, sizes, many = [], [], [], []
            for s in shingle_sets(b.column(0), k):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    if some is not None and not in_filter(np.array([c], np.int64).view(U), *some.value)[0]:
                        continue
                    tokens.append((mix(_prefix(s, common.value.grades(s), order, t)) & ~U(7)) | U(order))
                    names.append(c)
                    sizes.append(len(s))
                    many.append(len(tokens[-1]))
            if tokens:
                yield pa.record_batch([pa.array(signed(np.concatenate(tokens))), pa.array(np.repeat(np.array(names, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many))], ["token", "cls", "n"])

    return docs.mapInArrow(emit, "token long, cls long, n int")


def _candidates(texts: DataFrame, k: int, t: Fraction, common) -> DataFrame:
    """(a, b): pairs of classes that share enough prefix tokens under every order, or are neighbours in a chain."""
    sc, some, found = texts.sparkSession.sparkContext, None, None
    for o in range(ORDERS):
        rows = _prefixes(texts, k, t, common, o, some).repartition("token").sortWithinPartitions("token", "n", "cls")
        pairs = rows.mapInArrow(_partners(t), "a long, b long, need int").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need"), F.min("need").alias("least"))
        pairs = pairs.where("least = 0 OR c >= need").select("a", "b", (F.col("least") == 0).alias("chained"))
        pairs = materialise(pairs, f"pairs-{o}")
        release(texts.sparkSession)
        if o + 1 < ORDERS:
            some = sc.broadcast(_filter_words(pairs.select("a").union(pairs.select("b")).distinct()))
        found = pairs if found is None else found.union(pairs)
    found = found.groupBy("a", "b").agg(F.count("*").alias("c"), F.bool_or("chained").alias("chained"))
    return materialise(found.where((F.col("c") == ORDERS) | F.col("chained")).select("a", "b"), "candidates")


def _partners(t: Fraction):
    """Streams rows sorted by (token, n); gives (a, b, need) for documents that share a token and may be alike: how many they must
    share, 0 for neighbours in a chain."""
    num, den = t.numerator, t.denominator

    def pairs(token, cls, n, first_big: bool):
        """first_big: the first token's group goes on from rows seen before and is large."""
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[start, len(token)])
        big = np.repeat(size > SMALL, size)
        if first_big:
            big[: size[0]] = True
        for d in range(1, SMALL):
            if d >= len(token):
                break
            ok = (token[d:] == token[:-d]) & (n[:-d].astype(np.int64) * den >= n[d:].astype(np.int64) * num)
            ok &= (~big[d:]) | (d == 1)
            i = np.flatnonzero(ok)
            if not len(i):
                continue
            need = np.where(big[i + d], 0, 1 + n[i] // PER_SHARED).astype(np.int32)  # of the smaller, as sizes ascend
            yield np.minimum(cls[i], cls[i + d]), np.maximum(cls[i], cls[i + d]), need

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, big = None, False
        for b in _then_none(batches):
            if b is None:
                if held is None or not len(held[0]):
                    return
                token, cls, n = held
                cut = len(token)
            else:
                token, cls, n = (np.asarray(b.column(k)) for k in range(3))
                if held is not None:
                    token, cls, n = (np.concatenate(x) for x in zip(held, (token, cls, n)))
                if not len(token):
                    continue
                new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]  # copies from several tasks
                token, cls, n = token[new], cls[new], n[new]
                cut = int(np.searchsorted(token, token[-1])) if not (token[0] == token[-1]) else 0
            done = list(pairs(token[:cut], cls[:cut], n[:cut], big)) if cut else []
            if b is not None:
                was_big = big if cut == 0 else False
                held, big = [x[cut:] for x in (token, cls, n)], was_big
                if len(held[0]) > 4 * SMALL:  # a large group: chain it so far and keep its last row
                    done += list(pairs(*held, True))
                    held, big = [x[-1:] for x in held], True
            for a, z, need in done:
                yield pa.record_batch([pa.array(a), pa.array(z), pa.array(need)], ["a", "b", "need"])
            give_back()

    return run


def _then_none(items):
    yield from items
    yield None


def _filter_words(names: DataFrame) -> tuple[np.ndarray, int]:
    """Bits at the low bits of the given longs, in a table whose size is bounded by FILTER_BITS."""
    n = names.count()
    bits = min(FILTER_BITS, 1 << max(16, math.ceil(math.log2(16 * n + 1))))
    at = F.col(names.columns[0]).bitwiseAND(F.lit(bits - 1))
    got = names.select(at.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(i & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got["w"], np.int64)] = np.asarray(got["bits"], np.int64)
    return out.view(np.uint64), bits


def in_filter(x: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Which of x a filter of _filter_words may hold."""
    i = x & U(bits - 1)
    return (words[(i >> U(6)).astype(np.int64)] >> (i & U(63))) & U(1) != 0


def _texts_of(texts: DataFrame, k: int, some) -> DataFrame:
    """(cls, size, packed): a text of each class in the filter, its bytes and their number."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches, 1000):
            names, sizes, packed = [], [], []
            for s, x in zip(shingle_sets(b.column(0), k), b.column(0)):
                if len(s) and (c := class_of(s)) not in seen and in_filter(np.array([c], np.int64).view(U), *some.value)[0]:
                    seen.add(c)
                    raw = x.as_py().encode()
                    names.append(c)
                    sizes.append(len(raw))
                    packed.append(pa.compress(raw, codec="zstd", asbytes=True))
            if names:
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], ["cls", "size", "packed"])

    rows = texts.mapInArrow(emit, "cls long, size int, packed binary")
    return rows.groupBy("cls").agg(F.any_value(F.struct("size", "packed")).alias("x")).select("cls", "x.size", "x.packed")


def _dealt(groups: DataFrame, weights: DataFrame, t: Fraction) -> DataFrame:
    """(comp, i, j, own, cls, weight, one): each class of a component once for each pair (i, j) of blocks that it takes part in;
    own is its block, one tells a component of a single block."""
    width = max(math.log(1 / t), 0.01) * (1 + 1e-9)
    members = groups.join(weights.select(F.col("cls").alias("node"), "weight", "n"), "node").withColumn("band", F.floor(F.log("n") / width).cast("int"))
    bands = members.groupBy("comp", "band").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
    parts = F.ceil(F.greatest(F.col("docs") * 2 / BLOCK, F.col("tokens") * 2 / TOKENS)).cast("int").alias("parts")
    layout = bands.groupBy("comp").agg(((F.sum("docs") <= BLOCK) & (F.sum("tokens") <= TOKENS)).alias("one"), F.map_from_entries(F.collect_list(F.struct("band", parts))).alias("parts"))  # some 1,000 bands at most
    members = members.join(layout, "comp").withColumn("side", F.when(F.col("one"), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")[F.col("band")])).cast("long"))
    block = lambda band, side: F.shiftleft(F.lit(band).cast("long"), 32) + side
    own = F.when(F.col("one"), F.lit(0).cast("long")).otherwise(block(F.col("band"), F.col("side")))
    near = F.filter(F.array(*[F.col("band") + d for d in (-1, 0, 1)]), lambda b: F.col("parts")[b].isNotNull())
    others = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.col("parts")[b] - 1), lambda s: block(b, s))))
    members = members.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("one"), F.array("own")).otherwise(others)))
    return members.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("node").alias("cls"), "weight", "one")


def _less_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, size, packed) of rows (cls, size, packed, base_size, base), packed anew with the base as dictionary."""
    last, pack = None, None
    for b in batches:
        out = []
        for n, x, m, y in zip(*(b.column(c).to_pylist() for c in range(1, 5))):
            if y != last:
                last, pack = y, _with_base(pa.decompress(y, m, "zstd", asbytes=True))[0]
            out.append(pack.compress(pa.decompress(x, n, "zstd", asbytes=True)))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], ["cls", "size", "packed"])


def _with_base(base: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    if len(base) < 8:  # too short for a dictionary
        return zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    d = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def _with_texts(dealt: DataFrame, packed: DataFrame) -> DataFrame:
    """Dealt rows with (size, packed).  Those of a component beyond one block are packed with the text of the class that names
    the component as dictionary, which each pair of blocks gets as a row of its own block -1."""
    columns = ["comp", "i", "j", "own", "cls", "weight", "size", "packed"]
    few, many = dealt.where("one"), dealt.where("NOT one")
    # a component has more than BLOCK classes or TOKENS tokens, so there are few of these
    bases = materialise(many.select("comp").distinct().join(packed.select(F.col("cls").alias("comp"), F.col("size").alias("base_size"), F.col("packed").alias("base")), "comp"), "bases")
    held = bases.agg(F.coalesce(F.sum(F.length("base") + 64), F.lit(0))).first()[0]
    sent = F.broadcast(bases) if held <= BASES else bases
    members = many.select("comp", "cls").distinct().join(packed, "cls").join(sent, "comp")
    less = members.select("cls", "size", "packed", "base_size", "base").mapInArrow(_less_base, "cls long, size int, packed binary")
    firsts = many.select("comp", "i", "j").distinct().join(sent, "comp").select("comp", "i", "j", F.lit(-1).cast("long").alias("own"), F.col("comp").alias("cls"), F.lit(0).cast("long").alias("weight"), F.col("base_size").alias("size"), F.col("base").alias("packed"))
    return few.join(packed, "cls").select(*columns).union(many.join(less, "cls").select(*columns)).union(firsts.select(*columns))


def _shared(parts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many entries each set of left shares with each of right, as a matrix."""
    flat = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, code, many = np.unique(flat, return_inverse=True, return_counts=True)
    keep = many[code] >= 2
    code, owner = np.unique(code[keep], return_inverse=True)[1], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    place = np.argsort(code, kind="stable")
    code, owner = code[place], owner[place]
    top = int(code[-1]) + 1 if len(code) else 0
    step = max(64, (8 << 20) // max(1, len(parts)))
    for at in range(0, top, step):
        lo, hi = np.searchsorted(code, [at, at + step])
        m = np.zeros((len(parts), min(step, top - at)), np.float32)
        m[owner[lo:hi], code[lo:hi] - at] = 1
        out += m[left] @ m[right].T
    return out


def _verifier(k: int, t: Fraction, common):
    num, den = t.numerator, t.denominator

    def verify(group: pa.Table) -> pa.Table:
        cls = np.asarray(group["cls"].combine_chunks())
        own = np.asarray(group["own"].combine_chunks())
        weight = np.asarray(group["weight"].combine_chunks()).astype(np.float64)
        size, packed = group["size"].to_pylist(), group["packed"].to_pylist()
        if (own < 0).any():
            at = int(np.flatnonzero(own < 0)[0])
            unpack = _with_base(pa.decompress(packed[at], size[at], "zstd", asbytes=True))[1]
            rest = np.flatnonzero(own >= 0)
            texts = [unpack.decompress(packed[r], max_output_size=size[r]).decode() for r in rest.tolist()]
            cls, own, weight = cls[rest], own[rest], weight[rest]
        else:
            texts = [pa.decompress(x, n, "zstd").to_pybytes().decode() for x, n in zip(packed, size)]
        del packed
        sets = shingle_sets(pa.array(texts, pa.string()), k)
        del texts
        i, j = int(group["i"][0].as_py()), int(group["j"][0].as_py())
        every = np.arange(len(sets))
        left, right = (every, every) if i == j else (every[own == i], every[own == j])
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.float64())})
        candidate = np.ones((len(left), len(right)), bool)
        grades = [common.value.grades(s) for s in sets]
        need = np.array([1 + len(s) // PER_SHARED for s in sets])
        need = np.minimum(need[left][:, None], need[right][None, :])
        for o in range(ORDERS):
            candidate &= _shared([_prefix(s, g, o, t) for s, g in zip(sets, grades)], left, right) >= need
        both = _shared(sets, left, right)
        size = np.array([len(s) for s in sets], np.float64)
        joined = size[left][:, None] + size[right][None, :] - both
        linked = candidate & (both * den >= joined * num)
        if i == j:
            np.fill_diagonal(linked, False)
        a, b, links = [], [], np.zeros(len(sets))
        np.add.at(links, left, linked @ weight[right])
        if i != j:
            np.add.at(links, right, linked.T @ weight[left])
        # a spanning forest: each reached document points to where its part began
        free = np.ones(len(sets), bool)
        rows_of = {int(x): r for r, x in enumerate(left)}
        cols_of = {int(x): c for c, x in enumerate(right)}
        for s in every:
            if not free[s]:
                continue
            free[s], todo = False, [int(s)]
            while todo:
                x = todo.pop()
                near = set()
                if x in rows_of:
                    near.update(right[linked[rows_of[x]]].tolist())
                if x in cols_of:
                    near.update(left[linked[:, cols_of[x]]].tolist())
                for y in near:
                    if free[y]:
                        free[y] = False
                        a.append(cls[s]), b.append(cls[y])
                        todo.append(y)
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array([*a, *cls[some].tolist()], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()), "links": pa.array([*[None] * len(a), *links[some].tolist()], pa.float64())})

    return verify


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: str = "0.9") -> DataFrame:
    """(id_col, n_shingles, component_id, n_links) for each row of docs.

    Words are lower-cased (A-Z) and split at ASCII white space; a document's set is its distinct k-word
    shingles, or its whole sequence of words if it has fewer.  Two documents link when the Jaccard similarity
    of their sets reaches the threshold (a decimal, compared exactly); component_id is the least id that links
    reach, the document's own included, and n_links the number of other documents it links with.  Null texts,
    empty texts and texts of white space have an empty set, link with nothing and are their own component.
    Rows that repeat are documents of their own, with equal sets; a null id is never the least of others.  Other
    columns of docs take no part.  No documents give no rows.
    """
    spark, t = docs.sparkSession, Fraction(threshold)
    ship(spark)
    sc = spark.sparkContext
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(source.dtypes)["id"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            sets = shingle_sets(b.column(1), k)
            yield pa.record_batch([b.column(0), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["id", "cls", "n"])

    described = materialise(source.mapInArrow(describe, f"id {id_type}, cls long, n long"), "sets")
    texts = source.select("text")
    common = sc.broadcast(_order(texts, k))
    groups = materialise(connected_components(_candidates(texts, k, t, common)), "groups")
    packed = _texts_of(texts, k, sc.broadcast(_filter_words(groups.select("node"))))
    weights = described.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.max("n").alias("n"))
    weights = materialise(weights, "classes")
    dealt = _with_texts(materialise(_dealt(groups, weights, t), "dealt"), materialise(packed, "texts"))
    found = materialise(dealt.groupBy("comp", "i", "j").applyInArrow(_verifier(k, t, common), "a long, b long, links double"), "links")
    release(spark)
    comps = connected_components(found.where("b IS NOT NULL"))
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("links").cast("long").alias("others"))
    classes = weights.join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = classes.where(F.col("node").isNotNull()).groupBy("comp").agg(F.min("least").alias("comp_least"))
    classes = classes.select("cls", "weight", "least", "comp").join(least, "comp", "left").join(links, F.col("cls") == F.col("a"), "left")
    classes = classes.select(F.col("cls").alias("c"), F.coalesce("comp_least", "least").alias("component"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = described.join(materialise(classes, "classes"), F.col("cls") == F.col("c"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: str = "0.8") -> DataFrame:
    """The rows of docs that are the least of their component, with all their columns; rows that share that id all stay.
    Rows whose id is null stay as well."""
    kept = jaccard_components(docs, id_col=id_col, text_col=text_col, k=k, threshold=threshold)
    (gone,) = spare(docs, "gone_")
    drop = materialise(kept.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct(), "dropped")
    return docs.join(F.broadcast(drop) if drop.count() <= MAX_BROADCAST else drop, docs[id_col] == drop[gone], "left_anti")
