"""Components beyond one task: long chains, as large groups of near copies give, end in few rounds."""

import random

import pytest

pytest.importorskip("murmur.llm")

from murmur.llm import components
from murmur.operators import graph


def test_chains_end_in_rounds_that_grow_with_the_logarithm(spark, monkeypatch):
    r = random.Random(3)
    ids = [r.randrange(-(1 << 62), 1 << 62) for _ in range(2500)]
    edges = list(zip(ids[:2000], ids[1:2000])) + list(zip(ids[2000:2400], ids[2001:2400])) + [(ids[0], ids[0]), (ids[2450], ids[2450]), (ids[2451], None), (None, None)]
    edges += edges[:9]
    n = []

    def counted(kept):
        def write(df, name):
            n.append(name)
            assert len(n) <= 30
            return kept(df, name)

        return write

    monkeypatch.setattr(graph, "written", counted(graph.written))
    monkeypatch.setattr(components, "materialise", counted(components.materialise))
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), few=0)
    want = {x: min(ids[:2000]) for x in ids[:2000]} | {x: min(ids[2000:2400]) for x in ids[2000:2400]} | {ids[2450]: ids[2450]}
    rows = got.collect()
    assert {x.node: x.comp for x in rows} == want and len(rows) == len(want)
