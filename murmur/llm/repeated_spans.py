"""Repeated passages, by compaction of a de Bruijn graph of word windows.

The windows of k words are the edges of the graph.  Counting all of them would move every word of the corpus
k times, so a filter comes first: each window is named by the least hash of its short word sequences, and
only windows whose name occurs at two places or more can repeat.  The remaining edges are counted, and an edge that
repeats is kept with its count and its source, the least of its coordinates.  A batch sends each of its edges once, with how often it has
it, and stretches of further places, which one join leads to their edges.  Along a document, consecutive edges whose
sources follow each other are a path that the source spells too, and compact into one span with one source: so each
window of a span agrees with the one at the span's source and at the same distance.  Spans are joined back to their
documents by their coordinates, and there the words that they cover are cut out.

Counts change along a path wherever one of many near copies departs from it, so spans of one count each, which
``repeated_spans`` gives by default, grow with the square of such a group until they are single windows.  The cut needs no
counts and takes whole paths: a document has some for each of its own changes, however many copies there are.  A path may
go round a cycle (a word or line over and over); it is one stretch then, with the length of a round as its period.

A window is told by 95 bits, 64 of a hash of its words and 31 of another; the two come from hash functions of bytes that
share nothing, so words that collide in one do not in the other.  Windows that agree in both are taken as equal; the words
of two documents are not compared byte by byte.

Only documents that may have a span, by a filter of bounded size, are sent to meet their spans; the others stay where
they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._common import materialise, release, ship, spare
from murmur.llm._words import U, buffers, give_back, hashes, mix, signed, sliced, windows
from murmur.llm.jaccard_join import _filter_words, in_filter


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def _names(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of k words: is it within one row; its name; the hashes that names are chosen from."""
    short = (k + 1) // 2 - 2 if k >= 8 else 1
    if len(h) < k:
        return np.zeros(0, bool), h[:0], h[:0]
    grams = windows(h, short, seed=5)
    name = _least(grams, k - short + 1)
    inside = np.zeros(len(name), bool)
    ends = rows[1:] - k + 1
    change = np.zeros(len(h) + 1, np.int64)
    some = ends > rows[:-1]
    np.add.at(change, rows[:-1][some], 1)
    np.add.at(change, ends[some], -1)
    inside[:] = np.cumsum(change)[: len(name)] > 0
    return inside, name, grams


def _chosen(inside: np.ndarray, name: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The hash at each place that names some window over it."""
    if not len(name):
        return grams[:0]
    w = len(grams) - len(name) + 1
    pad = np.zeros(w - 1, U)
    over = ~_least(~np.concatenate([pad, np.where(inside, name, U(0)), pad]), w)  # the greatest name among the windows over a place
    return grams[(over == grams) & (over > 0)]


def _repeats(column, k: int):
    h, rows = hashes(*buffers(column), fold=None)
    return (h, rows, *_names(h, rows, k))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 35, counts: bool = True) -> DataFrame:
    """(key1, key2, spans): for each distinct (id, text) that has repeats, the windows that repeat as an array of
    (at, n, count, source1, source2, source_at): maximal runs of n consecutive windows from word ``at`` on that each start
    ``count`` times in all of docs and whose sources follow each other from word source_at of the document (source1,
    source2) on.  key1 and key2 are xxhash64 of the id and of the text.  Without counts, spans are whole paths, as (at, n,
    period, source1, source2, source_at): window i of a span is that of word source_at + i % period of its source.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    source = docs.select(F.xxhash64(F.col(id_col)).alias("key1"), F.xxhash64(F.col(text_col).cast("string")).alias("key2"), F.col(text_col).cast("string").alias("text"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1000):
            _, _, inside, name, grams = _repeats(b.column(0), k)
            x, n = np.unique(_chosen(inside, name, grams), return_counts=True)
            yield pa.record_batch([pa.array(signed(x)), pa.array(n.astype(np.int32))], ["name", "n"])

    twice = source.select("text").mapInArrow(names, "name long, n int").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    words, bits = _filter_words(materialise(twice.select("name"), "names"))
    release(spark)
    filter_words = sc.broadcast(words)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each edge once a batch, at the least of its places there, and how often the batch has it; its other places follow as
        stretches (e2 = -1) that name that place."""
        for b in sliced(batches, 1000):
            h, rows, inside, name, _ = _repeats(b.column(2), k)
            at = np.flatnonzero(inside & in_filter(name, filter_words.value, bits)) if len(name) else np.zeros(0, np.int64)
            if not len(at):
                continue
            other, _ = hashes(*buffers(b.column(2)), fold=None, which=1)
            one, two = windows(h, k, seed=1)[at], (windows(other, k, seed=2)[at] >> U(33)).astype(np.int32)
            row = np.searchsorted(rows, at, side="right") - 1
            pos = (at - rows[row]).astype(np.int32)
            key1, key2 = np.asarray(b.column(0))[row], np.asarray(b.column(1))[row]
            place = np.lexsort((pos, key2, key1, two, one))  # of an edge's places the least comes first
            new = np.flatnonzero(np.r_[True, (one[place][1:] != one[place][:-1]) | (two[place][1:] != two[place][:-1])])
            many = np.diff(np.r_[new, len(place)])
            first = np.empty(len(at), np.int64)
            first[place] = np.repeat(place[new], many)
            o = np.argsort(place[new])  # in order of place: neighbours then share their keys, which compress
            head, many = place[new][o], many[o].astype(np.int32)
            nothing = lambda t: pa.nulls(len(head), t)
            yield pa.record_batch([pa.array(signed(one[head])), pa.array(two[head]), pa.array(many), pa.array(key1[head]), pa.array(key2[head]), pa.array(pos[head]), nothing(pa.int32()), nothing(pa.int32()), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int32())], names_)
            more = np.flatnonzero(first != np.arange(len(at)))
            if len(more):
                f = first[more]
                cut = np.r_[True, (np.diff(at[more]) != 1) | (np.diff(row[more]) != 0) | (np.diff(at[f]) != 1) | (np.diff(row[f]) != 0)]
                cut = np.flatnonzero(cut)
                long = np.diff(np.r_[cut, len(more)]).astype(np.int32)
                m, f = more[cut], f[cut]
                turn = _rounds(at[m], long, f, row[m])
                m, f, period, long = m[turn], f[turn], long[turn], np.add.reduceat(long, turn).astype(np.int32)
                lone = mix(at[m].astype(U) + one[m])  # an edge of its own
                yield pa.record_batch([pa.array(signed(lone)), pa.array(np.full(len(m), -1, np.int32)), pa.array(np.zeros(len(m), np.int32)), pa.array(key1[m]), pa.array(key2[m]), pa.array(pos[m]), pa.array(long), pa.array(period), pa.array(key1[f]), pa.array(key2[f]), pa.array(pos[f])], names_)

    names_ = ["e1", "e2", "n", "key1", "key2", "at", "len", "period", "first1", "first2", "first_at"]
    found = source.mapInArrow(edges, "e1 long, e2 int, n int, key1 long, key2 long, at int, len int, period int, first1 long, first2 long, first_at int")
    edge = Window.partitionBy("e1", "e2")
    counted = found.withColumn("count", F.sum("n").over(edge)).withColumn("s", F.min(F.struct("key1", "key2", "at")).over(edge)).where("count > 1 OR e2 = -1")
    counted = materialise(counted.drop("e1", "n", *[] if counts else ["count"]), "edges")
    count = ["count"] if counts else []
    own = counted.where("e2 >= 0").groupBy("key1", "key2").agg(F.collect_list(F.struct("at", *count, F.col("s.key1").alias("source1"), F.col("s.key2").alias("source2"), F.col("s.at").alias("source_at"))).alias("own"))
    more = counted.where("e2 = -1").groupBy(F.col("first1").alias("key1"), F.col("first2").alias("key2")).agg(F.collect_list(F.struct(F.col("key1").alias("to1"), F.col("key2").alias("to2"), "at", "len", "period", "first_at")).alias("more"))
    fields = ["at int", "n int", "period int", *[f"{c} long" for c in count], "source1 long", "source2 long", "source_at int"]
    stretches = own.join(more, ["key1", "key2"], "left").mapInArrow(_stretches, ", ".join(["key1 long, key2 long", *fields]))
    spans = stretches.groupBy("key1", "key2").agg(F.collect_list(F.struct(*[f.split()[0] for f in fields])).alias("p"))
    fields = [f for f in fields if not counts or f != "period int"]
    out = materialise(spans.mapInArrow(_compact, f"key1 long, key2 long, spans array<struct<{', '.join(fields)}>>"), "spans")
    release(spark)
    return out


def _columns(items: pa.StructArray) -> list[np.ndarray]:
    return [np.asarray(items.field(i)).astype(np.int64) for i in range(items.type.num_fields)]


def _runs(at: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Where runs begin: consecutive places, consecutive places of the source (the last column), all else equal."""
    go = (np.diff(at) == 1) & (np.diff(rest[-1]) == 1)
    for x in rest[:-1]:
        go &= np.diff(x) == 0
    return np.flatnonzero(np.r_[True, ~go])


def _rounds(at: np.ndarray, n: np.ndarray, source_at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Of runs in order, where a path begins that goes round a cycle: its runs follow each other and start at one place of the source;
    all are as long as the first, but for the last, which may be shorter."""
    link = (at[1:] == at[:-1] + n[:-1]) & (source_at[1:] == source_at[:-1]) & (n[1:] <= n[:-1])
    for x in same:
        link &= x[1:] == x[:-1]
    go = link.copy()
    go[1:] &= ~(link[:-1] & (n[1:-1] < n[:-2]))  # nothing goes on after a shorter one
    return np.flatnonzero(np.r_[True, ~go])


def _paths(to1, to2, at, n, *rest) -> list[np.ndarray]:
    """Stretches in order, those joined that are one path, with the period of each after its length."""
    go = (at[1:] == at[:-1] + n[:-1]) & (rest[-1][1:] == rest[-1][:-1] + n[:-1])
    for x in (to1, to2, *rest[:-1]):
        go &= x[1:] == x[:-1]
    new = np.flatnonzero(np.r_[True, ~go])
    n = np.add.reduceat(n, new)
    to1, to2, at, *rest = (x[new] for x in (to1, to2, at, *rest))
    turn = _rounds(at, n, rest[-1], to1, to2, *rest[:-1])
    return [to1[turn], to2[turn], at[turn], np.add.reduceat(n, turn), n[turn], *(x[turn] for x in rest)]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of a document, and those that a batch led to it, as stretches of one source, and of one count if counts are given."""
    for b in sliced(batches, 500):
        fields = list(b.column(2).type.value_type)
        out: list[list[np.ndarray]] = []
        for i in range(len(b)):
            key1, key2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            at, *rest = _columns(b.column(2)[i].values)
            o = np.unique(at, return_index=True)[1]  # a repeated row has its places again
            at, *rest = (x[o] for x in (at, *rest))
            new = _runs(at, *rest)
            n = np.diff(np.r_[new, len(at)])
            out.append([np.full(len(new), key1), np.full(len(new), key2), at[new], n, n, *(x[new] for x in rest)])
            if not b.column(3)[i].is_valid:
                continue
            to1, to2, to, long, period, first = _columns(b.column(3)[i].values)
            times = -(-long // period)
            each = np.repeat(np.arange(len(to)), times)
            done = (np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)) * period[each]
            to1, to2, to, long, first = to1[each], to2[each], to[each] + done, np.minimum(period[each], long[each] - done), first[each]
            lo = np.searchsorted(at, first)
            a, z = np.searchsorted(new, lo, side="right") - 1, np.searchsorted(new, lo + long - 1, side="right")  # runs that a stretch meets
            which = np.repeat(np.arange(len(to)), z - a)
            run = np.arange(len(which)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + a[which]
            begin = np.maximum(new[run], lo[which])
            end = np.minimum(new[run] + n[run], (lo + long)[which])
            out.append(_paths(to1[which], to2[which], to[which] + begin - lo[which], end - begin, *(x[begin] for x in rest)))
        if out:
            cols = [np.concatenate(x) for x in zip(*out)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *(f.type for f in fields[1:])]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["key1", "key2", "at", "n", "period", *(f.name for f in fields[1:])])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a document as maximal spans; with counts, rounds of a cycle are spans of their own."""
    for b in sliced(batches, 500):
        fields = [(f.name, f.type) for f in b.column(2).type.value_type]
        counts = "count" in dict(fields)
        fields = [f for f in fields if not counts or f[0] != "period"]
        spans = []
        for p in b.column(2):
            at, n, period, *rest = _columns(p.values)
            each = np.repeat(np.arange(len(at)), n)
            step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            at, o = np.unique(at[each] + step, return_index=True)
            *rest, source_at = (x[each][o] for x in rest)
            rest.append(source_at + (step % period[each])[o])
            new = _runs(at, *rest)
            n = np.diff(np.r_[new, len(at)])
            at, *rest = (x[new] for x in (at, *rest))
            if not counts:
                turn = _rounds(at, n, rest[-1], *rest[:-1])
                at, n, *rest = at[turn], np.add.reduceat(n, turn), n[turn], *(x[turn] for x in rest)
            spans.append([dict(zip([f for f, _ in fields], x)) for x in zip(*(c.tolist() for c in (at, n, *rest)))])
        yield pa.record_batch([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.struct(fields)))], ["key1", "key2", "spans"])


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 35) -> DataFrame:
    """docs with n_words, n_removed (long), kept (the words left, joined by one space) and kept_sha256.

    Words are split at ASCII white space and taken as they are.  Each word is removed that is covered by a window
    of k consecutive words of one document whose words also start anywhere else, in the same document or another;
    windows are judged on docs as given.  Null, empty and blank texts have no words; texts of fewer than k words
    lose none.  Rows that repeat repeat each other's windows, so both lose them.  Columns with the new names are
    replaced, all others stay; no documents give no rows.
    """
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, k=k, counts=False)
    out = ["n_words", "n_removed", "kept", "kept_sha256"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in out])
    k1, k2, sp, res, maybe = spare(base, "key1_", "key2_", "spans_", "res_", "maybe_")
    spans = spans.select(F.col("key1").alias(k1 + "s"), F.col("key2").alias(k2 + "s"), F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"))).alias(sp))
    df = docs.select(*base.columns).withColumn(k1, F.xxhash64(F.col(id_col))).withColumn(k2, F.xxhash64(F.col(text_col).cast("string")))
    some = docs.sparkSession.sparkContext.broadcast(_filter_words(spans.select(k1 + "s")))

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(in_filter(np.asarray(keys).view(U), *some.value))

    df = df.withColumn(maybe, may(F.col(k1)))
    met = df.where(maybe).join(spans.hint("merge"), (df[k1] == spans[k1 + "s"]) & (df[k2] == spans[k2 + "s"]), "left").select(*base.columns, sp)
    df = met.unionByName(df.where(~F.col(maybe)).select(*base.columns, F.lit(None).cast(spans.schema[sp].dataType).alias(sp)))

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string, kept_sha256: string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        n, removed, kept, sha = [], [], [], []
        for text, some in zip(texts.to_pylist(), spans.to_pylist()):
            words = (text or "").encode().split()
            n.append(len(words))
            if some:
                off = np.zeros(len(words) + 1, np.int32)
                for s in some:
                    off[s["at"]] += 1
                    off[s["at"] + s["n"] + k - 1] -= 1
                gone = np.cumsum(off)[:-1] > 0
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            removed.append(n[-1] - len(words))
            left = b" ".join(words)
            kept.append(left.decode())
            sha.append(hashlib.sha256(left).hexdigest())
        out = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["n_words", "n_removed", "kept", "kept_sha256"])
        del kept
        give_back()
        return out

    df = df.withColumn(res, cut(F.col(text_col).cast("string"), F.col(sp)))
    return df.select(*base.columns, *[F.col(f"{res}.{c}").alias(c) for c in out])
