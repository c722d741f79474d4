"""Closures and duplicate groups against brute force: long paths, hubs, hot keys, odd rows."""

import random
import time

import pytest
from murmur.catalogue import dup_groups
from murmur.operators import graph


def united(pairs, nodes=()):
    up = {x: x for x in nodes}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def rounds(monkeypatch):
    """Counts the tables that are written."""
    n = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: n.append(name) or kept(df, name))
    return n


@pytest.mark.parametrize("hub", [3, graph.HUB])
def test_components_of_paths_stars_and_chance(spark, monkeypatch, hub):
    r = random.Random(hub)
    ids = list(range(3000))
    r.shuffle(ids)
    pairs = list(zip(ids[:1500], ids[1:1500]))  # one long path
    pairs += [(ids[1600], x) for x in ids[1601:2000]]  # a star
    pairs += [(r.choice(ids[2000:]), r.choice(ids[2000:])) for _ in range(700)]
    pairs += pairs[:5] + [(5, 5)]
    n = rounds(monkeypatch)
    got = graph.components(spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long").repartition(3), hub=hub)
    want = {x: t for x, t in united([p for p in pairs if p[0] != p[1]]).items()}
    assert {x.node: x.root for x in got.collect()} == want and got.count() == len(want)
    assert len(n) <= 1 + 2 * 12


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_groups_with_a_hot_key_nulls_and_repeats(spark):
    r = random.Random(1)
    rows = [(f"i{k:04}", "hot") for k in range(0, 900, 2)] + [(f"i{r.randrange(900):04}", f"k{r.randrange(600)}") for _ in range(500)]
    rows += [("alone", None), ("alone", None), (None, "hot"), ("i0001", None), *rows[:9]]
    got = graph.groups(spark.createDataFrame([(*x, 1) for x in rows], "item string, k string, i int"), "item", "k", hub=7).collect()
    keys = [((i, ""), ("~" + k, "")) for i, k in rows if i and k]
    items = {i for i, _ in rows if i}
    up = united([(a[0], b[0]) for a, b in keys], items)
    assert {x.item: x.group for x in got} == {i: up[i] for i in items} and len(got) == len(items)


def test_duplicate_groups_end_soon_on_the_tables(spark, monkeypatch):
    n, began = rounds(monkeypatch), time.time()
    assert dup_groups(spark, "/root/testdata/sf0.01").count() == 14743
    assert len(n) <= 2 + 2 * 12 and time.time() - began < 120


def test_ancestors_of_a_deep_graph_with_a_cycle(spark):
    edges = [(k, k + 1) for k in range(70)] + [(70, 60), (3, None), (None, 4), (3, 4)]
    got = graph.ancestors(spark.createDataFrame(edges, "parent int, child int"))
    want = {(c, a) for c in range(60) for a in range(c)} | {(c, a) for c in range(60, 71) for a in range(71)}
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    few = graph.ancestors(spark.createDataFrame(edges, "parent int, child int"), spark.createDataFrame([(5,), (5,), (99,)], "node int"))
    assert sorted(tuple(x) for x in few.collect()) == [(5, a) for a in range(5)]


def test_most_specific_over_edges_equals_that_over_the_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 1)], "parent int, child int")
    labels = spark.createDataFrame([("x", 1), ("x", 3), ("y", 2), ("z", 3), ("z", 2), ("z", 9), ("c", 1), ("c", 4)], "key string, label int")
    want = sorted(tuple(x) for x in graph.most_specific(labels, graph.ancestors(edges), "key").collect())
    assert sorted(tuple(x) for x in graph.most_specific_over(labels, edges, "key").collect()) == want
    assert ("y", 2) in want and ("x", 1) not in want and ("z", 2) not in want and ("c", 1) not in want
