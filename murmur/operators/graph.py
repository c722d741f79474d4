"""Ancestors in a graph with cycles, most specific labels, groups of things that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.sources.checkpoints import written

#: A node with more edges than this is joined by broadcast, so no task gets more edges of one node; there are at most
#: edges / HUB such nodes.
HUB = 100_000


def ancestors(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(node, ancestor) over edges (parent, child): all nodes above a node, however far; of the nodes in ``starts`` (node) only,
    where given.  In a cycle a node is its own ancestor.

    Only pairs found last are extended, by all pairs so far, so rounds grow with the logarithm of the depth (with starts, by the
    edges, so with the depth); no pair is found twice, so cycles end.  Pairs are written each round."""
    direct = edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    seen = new = written(direct if starts is None else direct.join(starts.select("node").distinct(), "node", "left_semi"), "above")
    while not new.isEmpty():
        by = seen if starts is None else direct
        step = new.join(by.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor").select("node", F.col("above").alias("ancestor")).distinct()
        new = written(step.join(seen, ["node", "ancestor"], "left_anti"), "above")
        seen = seen.union(new)
    return seen


def most_specific(labels: DataFrame, closure: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Labels of each key without those that are ancestors of another label of it."""
    above = labels.join(closure, labels[label] == closure["node"]).where(F.col("node") != F.col("ancestor")).select(key, F.col("ancestor").alias(label)).distinct()
    return labels.join(above, [key, label], "left_anti")


def most_specific_over(labels: DataFrame, edges: DataFrame, key: str, label: str = "label") -> DataFrame:
    """most_specific over edges (parent, child).  A label can only be dropped for another of its key, so the closure is sought
    from the labels of keys with several, and only those are joined with it."""
    several = labels.join(labels.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), key, "left_semi")
    closure = ancestors(edges, several.select(F.col(label).alias("node")))
    above = several.join(closure, several[label] == closure["node"]).where(F.col("node") != F.col("ancestor")).select(key, F.col("ancestor").alias(label)).distinct()
    return labels.join(above, [key, label], "left_anti")


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """(u, v, m) of edges (u, v) with m from least (u, m, n), n being how many edges u has.  Nodes of more than hub edges are
    joined by a broadcast of those nodes; hub None says that there are none."""
    if hub is None:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))  # at most edges / hub rows
    return edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u").union(edges.join(hubs, "u").select("u", "v", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", *, hub: int = HUB) -> DataFrame:
    """(node, root) of every node of an edge: root is the least node of its connected component.

    Stars alternate: each round every node hands its greater neighbours to its least neighbour, then its lesser neighbours to
    the least of them.  Edges never link what was not connected, and the graph ends as one star a component, after a number of
    rounds that grows with the logarithm of the nodes, however long the paths are.  Each round's edges are written once; a
    round without a change ends it.  Nodes of any type that has an order; self-loops, repeated edges and null ends are left out.
    """
    lesser = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    lesser, was = written(lesser, "edges"), None
    while True:
        n, mark = lesser.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, mark) == was or not n:
            return lesser.select(F.col("u").alias("node"), F.col("v").alias("root")).union(lesser.select("v", "v").distinct())
        was = (n, mark)
        limit = hub if 2 * n > hub else None
        both = lesser.union(lesser.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, limit)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        lesser = written(small.distinct(), "edges")


def groups(df: DataFrame, item: str, key: str, *, hub: int = HUB) -> DataFrame:
    """(item, group): items that share a key, directly or through others, have the same group, the least of them.

    Items of a key are linked to the least of their share of it, and those to the least of the key, so a key of any size is
    dealt over as many tasks as shuffles have.  Null items are left out; a null key links nothing."""
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = df.select(F.col(item).alias("i"), F.col(key).alias("k")).where("i IS NOT NULL").distinct()
    links = written(links.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(shares))), "links")
    near = links.where("k IS NOT NULL").select("k", "s", "i", F.min("i").over(Window.partitionBy("k", "s")).alias("m"))
    tops = near.where("i = m").select("k", "m").withColumn("t", F.min("m").over(Window.partitionBy("k")))  # a row a share
    edges = near.select(F.col("i").alias("a"), F.col("m").alias("b")).union(tops.select("m", "t"))
    found = components(edges, hub=hub).withColumnRenamed("node", "i")
    return links.select("i").distinct().join(found, "i", "left").select(F.col("i").alias(item), F.coalesce("root", "i").alias("group"))
