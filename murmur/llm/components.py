"""Connected components on DataFrames: of few edges in one task, of more by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import materialise, ship
from murmur.operators.graph import components

#: Up to so many edges one executor task joins them in memory, some 100 MB; beyond, rounds over the cluster.
FEW = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all edges of the task."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            up.setdefault(x, x), up.setdefault(y, y)
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], ["node", "comp"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, few: int = FEW) -> DataFrame:
    """(node, comp) for each end of an edge: comp is the least node of its component.

    Self-loops and repeated edges are allowed; edges with a null end are left out; no edges give no rows.  Ends are longs.
    At most ``few`` edges are joined by one task; more by rounds whose number grows with the logarithm of the nodes, however
    long their chains are.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = materialise(pairs.distinct(), "edges")
    if pairs.count() <= few:
        ship(edges.sparkSession)
        return materialise(pairs.coalesce(1).mapInArrow(_joined, "node long, comp long"), "labels")
    found = components(pairs).select("node", F.col("root").alias("comp"))
    loops = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("comp"))
    return materialise(found.union(loops.join(found, "node", "left_anti")), "labels")
