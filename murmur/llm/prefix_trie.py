"""The prefix trie of conversations, family first: small tries of families are built in tasks, their combined nodes merged.

A conversation c is rebuilt from the first h turns of its base, c - c % 20, and its own turns after its first h, where h is
crc32(c) % 4.  A node is a distinct sequence of first turns.  It is told by its depth and two 64-bit lanes, each the xor of a
hash of (depth, turn) over the sequence, so stretches of 1,024 turns are joined without walking a conversation from its
start: a family is cogrouped by stretch, and neither a long conversation nor a popular prefix meets in one task.

Sums over subtrees need no rounds: a node's gain is booked on its smallest member at its depth, since a node lies below
another just if its smallest member is a member of that one and it is not less deep; a node's sum is that of the gains that
its members have from its depth on.

Defined cases: rows without a conv_id belong to no conversation; null roles and texts are empty; a null turn comes first, and
turns that tie by digest of role and text; repeated rows are turns of their own; a conversation without turns left ends in the
root; no conversations give no nodes.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm._common import materialise, ship
from murmur.llm._order import ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a stretch, conversations of a family, ids whose list is one string.
STRETCH, FAMILY, LISTED = 1024, 20, 20480

_NODE = ["d", "a", "b"]
_PATHS = "base long, stretch long, c long, d long, a long, b long, pa long, pb long, w long, members long, ends long, last boolean"


def _longs(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy().astype(np.int64) for n in names]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _family(key: tuple[pa.Scalar, pa.Scalar], turns: pa.Table, convs: pa.Table) -> pa.Table:
    """The paths of a family's conversations through a stretch of depths; a node's first path carries how many of the family
    are its members and how many of them end there."""
    base, stretch = (k.as_py() for k in key)
    c, d, za, zb, w = _longs(turns, "c", "d", "za", "zb", "w")
    ids, m, total, ca, cb = _longs(convs, "c", "m", "total", "ca", "cb")
    head = [np.array([[s[k] for k in ("d", "za", "zb", "w")] for s in heads or []], np.int64).reshape(-1, 4) for heads in convs.column("heads").to_pylist()]
    if stretch == 0:  # the root and the turns of the base
        more = [np.vstack([np.zeros((1, 4), np.int64), t[:n]]) for t, n in zip(head, m)]
        flat = np.vstack(more)
        c = np.concatenate([c, np.repeat(ids, [len(x) for x in more])])
        d, za, zb, w = (np.concatenate([old, flat[:, i]]) for i, old in enumerate((d, za, zb, w)))
    else:
        ca = np.array([x ^ np.bitwise_xor.reduce(t[:n, 1]) for x, t, n in zip(ca, head, m)], np.int64)
        cb = np.array([x ^ np.bitwise_xor.reduce(t[:n, 2]) for x, t, n in zip(cb, head, m)], np.int64)
    at = np.lexsort((d, c))
    c, d, za, zb, w = c[at], d[at], za[at], zb[at], w[at]
    by_id = np.argsort(ids)
    who = by_id[np.searchsorted(ids[by_id], c)]
    start = _starts(c)
    size = np.diff(np.append(start, len(c)))

    def lane(z: np.ndarray, carry: np.ndarray) -> np.ndarray:
        run = np.bitwise_xor.accumulate(z)
        return run ^ np.repeat(run[start] ^ z[start], size) ^ carry[who]

    a, b = lane(za, ca), lane(zb, cb)
    last = d == total[who]
    at = np.lexsort((c, b, a, d))
    first = _starts(d[at], a[at], b[at])
    members, ends = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    members[at[first]] = np.diff(np.append(first, len(c)))
    ends[at[first]] = np.add.reduceat(last[at].astype(np.int64), first)
    cols = [np.full(len(c), base), np.full(len(c), stretch), c, d, a, b, a ^ za, b ^ zb, w, members, ends, last]
    return pa.table(cols, names=[f.split()[0] for f in _PATHS.split(", ")])


def _sums(key: tuple[pa.Scalar, pa.Scalar], paths: pa.Table, gains: pa.Table) -> pa.Table:
    """The family's part of each node's sums: its members' gains from the node's depth on; a gain of depth -1 is what a
    conversation gains in later stretches."""
    c, d, a, b = _longs(paths, "c", "d", "a", "b")
    at = np.lexsort((d, c))
    c, d, a, b = c[at], d[at], a[at], b[at]
    start = _starts(c)
    size = np.diff(np.append(start, len(c)))
    gc, gd = _longs(gains, "c", "d")
    which = np.searchsorted(c[start], gc)
    out = []
    for name in ("leaf", "saved"):
        (v,) = _longs(gains, name)
        row = np.zeros(len(c), np.int64)
        now = gd >= 0
        row[start[which[now]] + gd[now] - d[start[which[now]]]] = v[now]
        later = np.zeros(len(start), np.int64)
        np.add.at(later, which[~now], v[~now])
        ahead = np.cumsum(row) - row
        whole = np.add.reduceat(row, start)
        out.append(np.repeat(later + whole + ahead[start], size) - ahead)
    at = np.lexsort((b, a, d))
    first = _starts(d[at], a[at], b[at])
    node = at[first]
    return pa.table([d[node], a[node], b[node], *[np.add.reduceat(v[at], first) for v in out]], names=[*_NODE, "leaves", "saved"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's lists, joined by commas; lists of a node follow each other."""
    node, h = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != node:
                if node is not None:
                    done.append((*node, h.hexdigest()))
                node, h = key, sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield _listed(done)
    if node is not None:
        yield _listed([(*node, h.hexdigest())])


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.record_batch([*[pa.array(cols[i], pa.int64()) for i in range(3)], pa.array(cols[3], pa.string())], [*_NODE, "sha"])


def _fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be cogrouped with what it comes from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _z(lane: int, depth: Column) -> Column:
    return F.xxhash64(F.lit(lane), F.col("digest"), depth.cast("long"))


def _stretch(depth: str, stretch: int) -> Column:
    return F.floor(F.col(depth) / stretch).alias("stretch")


def paths(conversations: DataFrame, *, stretch: int = STRETCH) -> DataFrame:
    """A row for each rebuilt conversation c and depth d from 0: the node's lanes (a, b), its parent's (pa, pb), the words w of
    its last turn, whether the conversation ends there; and, on a family's first path through a node, how many of the family
    are members and how many end there.  Written.  Stretches are of 4 turns or more, so that the turns of a base fall into the first."""
    if stretch < 4:
        raise ValueError("a stretch has 4 turns or more")
    ship(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.left(F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256), F.lit(32))
    slim = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("digest"), F.regexp_count(text("text"), F.lit(WORD)).cast("long").alias("w"))
    turns = ranked(slim, "c", ["turn", "digest"], name="turns")
    base = (F.col("c") - F.col("c") % FAMILY).alias("base")
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    heads = turns.where((F.col("c") % FAMILY == 0) & (F.col("place") < 3)).withColumn("d", F.col("place") + 1)
    heads = heads.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("d", _z(1, F.col("d")).alias("za"), _z(2, F.col("d")).alias("zb"), "w"))).alias("heads"))
    heads = materialise(heads, "heads")
    taken = F.least(h, F.coalesce(F.size("heads"), F.lit(0)).cast("long"))
    taken = F.when(F.col("heads").isNull(), F.lit(0).cast("long")).otherwise(taken)
    own = turns.where(F.col("place") >= h).select("c", "place", "digest", "w", base).join(heads, "base", "left")
    own = own.withColumn("d", F.col("place") + 1 - h + taken).select("base", _stretch("d", stretch), "c", "d", _z(1, F.col("d")).alias("za"), _z(2, F.col("d")).alias("zb"), "w")
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumn("base", base).join(heads, "base", "left")
    zero = F.lit(0).cast("long")
    convs = convs.select("base", zero.alias("stretch"), "c", taken.alias("m"), (taken + F.greatest(zero, F.col("n") - h)).alias("total"), zero.alias("ca"), zero.alias("cb"), "heads")
    # what the turns before a stretch come to, for conversations of more than one
    parts = own.groupBy("base", "c", "stretch").agg(F.bit_xor("za").alias("xa"), F.bit_xor("zb").alias("xb"), F.max("d").alias("most"))
    whole = Window.partitionBy("base", "c")
    ahead = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    later = parts.select("base", "stretch", "c", F.max("most").over(whole).alias("total"), F.coalesce(F.bit_xor("xa").over(ahead), zero).alias("ca"), F.coalesce(F.bit_xor("xb").over(ahead), zero).alias("cb")).where("stretch > 0")
    later = later.join(heads, "base", "left").select("base", "stretch", "c", taken.alias("m"), "total", "ca", "cb", "heads")
    out = own.groupBy("base", "stretch").cogroup(_fresh(convs.unionByName(later)).groupBy("base", "stretch")).applyInArrow(_family, _PATHS)
    return materialise(out, "paths")


def prefix_trie(conversations: DataFrame, *, stretch: int = STRETCH, listed: int = LISTED) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    p = paths(conversations, stretch=stretch)
    nodes = p.where("members > 0").groupBy(*_NODE).agg(F.min("c").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("ends").alias("ends"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("w").alias("w"))
    nodes = materialise(nodes, "nodes")
    gains = nodes.select((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), _stretch("d", stretch), F.col("conv_id").alias("c"), "d", (F.col("ends") == F.col("n_convs")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("w")).alias("saved"))
    zero = F.lit(0).cast("long")
    beyond = p.where("stretch > 0").select("base", "stretch", "c", zero.alias("leaf"), zero.alias("saved")).union(gains.where("stretch > 0").select("base", "stretch", "c", "leaf", "saved"))
    beyond = beyond.groupBy("base", "stretch", "c").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    on = Window.partitionBy("base", "c").orderBy(F.desc("stretch"))
    beyond = beyond.select("base", (F.col("stretch") - 1).alias("stretch"), "c", F.lit(-1).cast("long").alias("d"), F.sum("leaf").over(on).alias("leaf"), F.sum("saved").over(on).alias("saved"))
    sums = p.select("base", "stretch", "c", *_NODE).groupBy("base", "stretch").cogroup(_fresh(gains.unionByName(beyond)).groupBy("base", "stretch")).applyInArrow(_sums, "d long, a long, b long, leaves long, saved long")
    sums = sums.groupBy(*_NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    ids = F.array_join(F.array_sort(F.collect_list("c")), ",")  # ``listed`` ids at most, as a conversation ends once
    ends = p.where("last").groupBy(*_NODE, (F.col("c") - F.pmod("c", F.lit(listed))).alias("from")).agg(ids.alias("ids"))
    ends = ends.repartition(*_NODE).sortWithinPartitions(*_NODE, "from").select(*_NODE, "ids").mapInArrow(_joined_ids, "d long, a long, b long, sha string")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, _NODE).join(kids, _NODE, "left").join(ends, _NODE, "left").join(above, ["d", "pa", "pb"], "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
