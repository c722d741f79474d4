"""Merkle manifests: the leaf, root and authentication path of every row, by fractal traversal of aligned blocks.

Rows of a tree are numbered over the cluster and cut into blocks of 3^8 leaves, aligned, so that a block is a whole subtree.
A task walks the blocks it has: the existing subtrees of the current leaf are stacked, and while their leaves' paths are
emitted, the desired subtrees that follow are hashed a leaf a step, so a block keeps a few hundred digests beside its leaves
and each path costs a few hashes.  The roots of the blocks are the leaves of the next tree, walked alike; a path is that of
the leaf in its block followed by that of its block, and so on to the root.

Defined cases: null fields are "-"; a null source is a tree of its own, the first; rows of one source with equal ids come in
the order of their leaves, equal rows included, each with a path of its own; a lone node is its own root; a null id has no
tampering; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import materialise, ship
from murmur.llm._order import ranked

ARITY = 3
#: Levels of a block, 6,561 leaves, and of each of its stacked subtrees.
HEIGHT, STACKED = 8, 2
#: Paths in an Arrow batch, some 2 MB.
_EMIT = 2000

PATH = "array<struct<before: string, after: string>>"


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


class Subtree:
    """The nodes of levels low to top - 1 below node ``index`` of level top, hashed from its leaves one step at a time."""

    def __init__(self, leaves: list[str], index: int, low: int, top: int):
        self.low, self.top, self.index, self.root = low, top, index, ""
        self.leaves, self.at = leaves, index * ARITY**top
        self.end = min(len(leaves), (index + 1) * ARITY**top)
        self.nodes: list[list[str]] = [[] for _ in range(top - low)]
        self.open: list[list[str]] = [[] for _ in range(top)]

    def _add(self, level: int, node: str) -> None:
        while level < self.top:
            if level >= self.low:
                self.nodes[level - self.low].append(node)
            run = self.open[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node, self.open[level] = digest(run), []
            level += 1
        self.root = node

    def step(self) -> None:
        """Take in the next leaf; with the last one, close the runs that are short."""
        if self.at >= self.end:
            return
        self._add(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for level in range(self.top):
                if self.open[level]:
                    run, self.open[level] = self.open[level], []
                    self._add(level + 1, digest(run))

    def finish(self) -> Subtree:
        while self.at < self.end:
            self.step()
        return self

    def beside(self, level: int, at: int) -> tuple[str, str]:
        """What stands before and after node ``at`` of the level in its run, concatenated."""
        row = self.nodes[level - self.low]
        i = at - self.index * ARITY ** (self.top - level)
        run = i - i % ARITY
        return "".join(row[run:i]), "".join(row[i + 1 : run + ARITY])


def root_of(leaves: list[str], height: int) -> str:
    """The node ``height`` levels above the leaves."""
    return Subtree(leaves, 0, height, height).finish().root


def walk(leaves: list[str], height: int, stacked: int = STACKED) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf in turn, level by level, within a tree of that height."""
    tops = list(range(stacked, height, stacked)) + ([height] if height else [])
    lows = [0, *tops[:-1]]
    existing = [Subtree(leaves, 0, lo, top).finish() for lo, top in zip(lows, tops)]
    desired = [Subtree(leaves, 1, lo, top) for lo, top in zip(lows[:-1], tops[:-1])]
    path: list[tuple[str, str]] = [("", "")] * height
    for p in range(len(leaves)):
        level = 0
        while level < height and (level == 0 or p % ARITY**level == 0):
            path[level] = existing[level // stacked].beside(level, p // ARITY**level)
            level += 1
        yield list(path)
        for i, tree in enumerate(desired):
            tree.step()
            if (p + 1) % ARITY ** tree.top == 0:
                existing[i], desired[i] = tree, Subtree(leaves, tree.index + 1, tree.low, tree.top)


def _blocks(batches: Iterator[pa.RecordBatch], most: int):
    for b in batches:
        rows = b.column(b.schema.get_field_index("rows"))
        for i, (key, block, n) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "block", "n")))):
            items = rows[i].values
            yield key, block, items, items.field("digest").to_pylist(), most if n > ARITY**most else height_of(n)


def _roots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for key, block, _, leaves, height in _blocks(batches, most):
        yield pa.record_batch([pa.array([key], pa.string()), pa.array([block], pa.int64()), pa.array([root_of(leaves, height)], pa.string())], ["key", "pos", "digest"])


def _walks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("before", pa.string()), ("after", pa.string())])
    for key, block, items, leaves, height in _blocks(batches, most):
        paths = walk(leaves, height)
        for at in range(0, len(leaves), _EMIT):
            part = items.slice(at, _EMIT)
            steps = [s for _, path in zip(range(len(part)), paths) for s in path]
            flat = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], fields=list(kind))
            offsets = pa.array([k * height for k in range(len(part) + 1)], pa.int32())
            out = [pa.array([key] * len(part), pa.string()), pa.array([block] * len(part), pa.int64()), part, pa.ListArray.from_arrays(offsets, flat)]
            yield pa.record_batch(out, ["key", "block", "row", "path"])


def authenticate(nodes: DataFrame, totals: DataFrame, *, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(nodes with their paths, roots): nodes is (key, pos, digest, item), pos from 0 without holes in each tree ``key``, item
    any struct; totals is (key, n).  The first result is (key, pos, digest, item, path), path being the siblings before and
    after a node in its run, level by level; the second (key, root).  Blocks have ``height`` levels."""
    ship(nodes.sparkSession)
    block = ARITY**height
    packed = nodes.select("key", F.floor(F.col("pos") / block).alias("block"), F.struct("pos", "digest", "item").alias("r"))
    packed = packed.groupBy("key", "block").agg(F.array_sort(F.collect_list("r"), lambda x, y: F.when(x["pos"] < y["pos"], -1).otherwise(1)).alias("rows"))  # 6,561 rows at most
    packed = materialise(packed.join(totals, "key"), "blocks")
    most = totals.agg(F.max("n")).first()[0] or 0
    roots = materialise(packed.mapInArrow(lambda b: _roots(b, height), "key string, pos long, digest string"), "roots")
    row = packed.schema["rows"].dataType.elementType.simpleString()
    inner = packed.mapInArrow(lambda b: _walks(b, height), f"key string, block long, row {row}, path {PATH}")
    if most <= block:
        return inner.select("key", "row.*", "path"), roots.select("key", F.col("digest").alias("root"))
    fewer = totals.select("key", F.ceil(F.col("n") / block).alias("n"))
    upper, tops = authenticate(roots.withColumn("item", F.struct(F.lit(0).alias("none"))), fewer, height=height)
    upper = materialise(upper.select("key", F.col("pos").alias("block"), F.col("path").alias("up")), "upper")
    out = inner.join(upper, ["key", "block"])
    return out.select("key", "row.*", F.concat("path", "up").alias("path")), tops


def field(column: Column) -> Column:
    """A field as it goes into a leaf: its length in bytes and its value, "-" for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def proof(path: Column) -> Column:
    """All siblings of a path, concatenated."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and the siblings of its path give."""
    return F.aggregate(path, node, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def manifest(df: DataFrame, fields: list[str], *, id_col: str, tree_col: str, other: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, tree, leaf, other, subroot, root, path) of every row: a tree a value of tree_col, leaves in the order of ids, and a
    tree over their roots in the order of those values.  ``other`` is a second leaf carried along, such as that of a copy to
    verify; proof() and fold() read the path."""
    key = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))  # null first
    other = F.lit(None).cast("string") if other is None else other
    slim = df.select(key.alias("key"), F.col(id_col).alias("id_"), leaf([F.col(c) for c in fields]).alias("digest"), other.alias("other"))
    rows = ranked(slim, "key", ["id_", "digest"], name="leaves")
    totals = materialise(rows.groupBy("key").agg(F.count("*").alias("n")), "totals")
    paths, subroots = authenticate(rows.select("key", F.col("place").alias("pos"), "digest", F.struct("id_", "other").alias("item")), totals, height=height)
    trees = ranked(subroots.withColumn("all_", F.lit("")), "all_", ["key"], name="trees")
    tops = trees.select(F.col("all_").alias("key"), F.col("place").alias("pos"), F.col("root").alias("digest"), F.struct(F.col("key").alias("tree")).alias("item"))
    upper, root = authenticate(tops, tops.groupBy("key").agg(F.count("*").alias("n")), height=height)
    upper = upper.join(root, "key").select(F.col("item.tree").alias("key"), F.col("digest").alias("subroot"), F.col("path").alias("up"), "root")
    out = paths.join(materialise(upper, "upper"), "key")
    tree = F.when(F.col("key") != "", F.substring("key", 2, 2147483647))
    return out.select(F.col("item.id_").alias(id_col), tree.alias(tree_col), F.col("digest").alias("leaf"), F.col("item.other").alias("other"), "subroot", "root", F.concat("path", "up").alias("path"))


def tampered_manifest(docs: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents against a copy in which the text of
    every document whose id has an even crc32 lost its line breaks."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = leaf([F.translate("text", "\n", "") if c == "text" else F.col(c) for c in fields])
    df = manifest(docs, fields, id_col="doc_id", tree_col="source", other=F.when(hit, cut), height=height)
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    df = df.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))
