"""Merkle manifests, prefix tries and mixes against brute force, on small and odd tables."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from murmur.llm import merkle
from murmur.llm._order import ranked
from murmur.llm.mixing import mix, targets
from murmur.llm.prefix_trie import prefix_trie

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, proofs) level by level over all nodes."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[i : i + 3]) for i in range(0, len(row), 3)])
    proofs = []
    for p in range(len(leaves)):
        path = []
        for row in levels[:-1]:
            run = p - p % 3
            path.append(("".join(row[run:p]), "".join(row[p + 1 : run + 3])))
            p //= 3
        proofs.append(path)
    return levels[-1][0], proofs


@pytest.mark.parametrize("stacked", [1, 2, 3])
def test_walk_gives_every_path_of_ragged_trees(stacked):
    for n in [*range(1, 31), 80, 81, 82, 200, 243, 244]:
        leaves = [H(str(i)) for i in range(n)]
        root, proofs = tree(leaves)
        h = merkle.height_of(n)
        assert merkle.root_of(leaves, h) == root
        assert list(merkle.walk(leaves, h, stacked)) == proofs
        assert len(list(merkle.walk(leaves, h + 2))) == n  # runs of one go on


def fold(node, path):
    for a, b in path:
        node = H(a, node, b)
    return node


def f(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest(rows):
    by = defaultdict(list)
    for d, s, lang, n, t in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        cut = t.replace("\n", "") if hit and t is not None else t
        by[s].append((d is not None, d or 0, H(f(d), f(s), f(lang), f(n), f(t)), H(f(d), f(s), f(lang), f(n), f(cut)), d))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: r[:3])
        trees[s] = tree([r[2] for r in by[s]])
    root, ups = tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, ups):
        for r, path in zip(by[s], trees[s][1]):
            path = path + up
            folded = fold(r[3], path)
            out.append((r[4], r[2], trees[s][0], root, H(*[a + b for a, b in path]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_equals_brute_force(spark, height):
    r = random.Random(height)
    rows = [(i, r.choice(["hot", "hot", "b", "ü", "z", None, ""]), r.choice(["en", None]), r.choice([1, None]), r.choice(["a\nb", "", None, "text\n" * 50])) for i in range(150)]
    rows += [rows[3], rows[3], (None, "hot", None, None, None), (None, None, None, None, "x\n"), (-5, "only", "en", 2, "\n")]
    got = merkle.tampered_manifest(spark.createDataFrame([(*x, "k", 7) for x in rows], DOCS + ", key string, place int").repartition(5), height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == manifest(rows)


def test_manifest_of_no_rows_and_of_one(spark):
    assert merkle.tampered_manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = [(4, "s", "en", 1, "a\nb")]
    assert [tuple(x) for x in merkle.tampered_manifest(spark.createDataFrame(one, DOCS)).collect()] == manifest(one)


def trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, H(str(len((role or "").encode())), ":", role or "", text or "")[:32], (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)

    def below(n):
        todo = [n]
        while todo:
            x = todo.pop()
            yield x
            todo += kids[x]

    out = []
    for n, m in members.items():
        sub = list(below(n))
        saved = sum((len(members[x]) - 1) * len([w for w in "".join(ch if ch not in " \t\n\x0b\x0c\r" else " " for ch in x[-1][1]).split(" ") if w]) for x in sub if x)
        ends = sorted(c for c in m if len(built[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), sum(not kids[x] for x in sub), saved, H(",".join(map(str, ends)))))
    return sorted(out, key=repr)


CONVS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("stretch,listed", [(4, 3), (1024, 20480)])
def test_trie_equals_brute_force(spark, stretch, listed):
    r = random.Random(5)
    rows = []
    for c in [*range(-25, 70), 1000, 1001, 1019]:
        if c == 40:
            continue  # a family without its base
        n = r.choice([1, 2, 3, 4, 9, 30]) if c != 20 else 2
        rows += [(c, r.choice([t, t, None]) if c % 7 == 0 else t, r.choice(["user", "user", None]), r.choice(["hello  there", "a b c", "", None])) for t in range(n)]
    rows += [(61, 3, "user", "same"), (61, 3, "user", "same"), (None, 1, "user", "lost"), (62, None, None, None)]
    rows += [(c, t, "user", f"common {t}") for c in range(200, 260) for t in range(5)]
    got = prefix_trie(spark.createDataFrame([(*x, 1) for x in rows], CONVS + ", d int").repartition(3), stretch=stretch, listed=listed)
    assert sorted(map(tuple, got.collect()), key=repr) == trie(rows)


def test_trie_of_nothing_and_of_null_ids(spark):
    assert prefix_trie(spark.createDataFrame([], CONVS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], CONVS)).count() == 0
    got = prefix_trie(spark.createDataFrame([(3, 0, "user", "a")], CONVS)).collect()
    assert sorted(map(tuple, got), key=repr) == trie([(3, 0, "user", "a")])


def test_ranked_numbers_a_hot_key_over_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot" if i % 3 else f"k{i % 5}", (i * 7919) % 1000, i % 11) for i in range(1000)]
        df = ranked(spark.createDataFrame(rows, "k string, o long, v long").repartition(7), "k", ["o"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = defaultdict(list)
    for k, o, v in sorted(rows):
        want[k].append((o, v))
    for row in df:
        at = [o for o, _ in want[row.k]].index(row.o)
        assert (row.place, row.before_v) == (at, sum(v for _, v in want[row.k][:at]))


def filled(sizes, weights, epochs):
    """Targets by rounds: what is over a limit goes to the others by weight."""
    total = sum(sizes)
    got, full = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(epochs * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        got = [float(epochs * s) if i in full else rest * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and got[i] > epochs * s}
        if not over:
            return got
        full |= over


def test_targets_equal_rounds_of_resharing(spark):
    r = random.Random(1)
    for n in (1, 2, 7, 30):
        sizes = [r.choice([0, 1, 5, 100, 1000, 100000]) + 1 for _ in range(n)]
        df = targets(spark.createDataFrame([(f"{i:03}", s) for i, s in enumerate(sizes)], "key string, size long"))
        want = filled(sizes, [i % 3 + 1 for i in range(n)], 3)
        assert [x.target for x in df.orderBy("key").collect()] == pytest.approx(want)


def test_mix_meets_its_targets(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "z", "", None, "\U0001f600", "é"]), "w " * r.choice([0, 1, 9, 40])) for i in range(300)]
    rows += [(7, "hot", "x y"), (7, "hot", "x y"), (None, "hot", None), (None, None, "a b c"), (999, "tiny", "one"), (1000, "empty", " ")]
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, source string, text string, size int, target double").repartition(4)
    got = mix(df).collect()
    assert len(got) == len(rows)
    again = mix(df.repartition(2)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in got:
        sizes[x.source] += x["size"]
        taken[x.source] += x.taken
        assert 0 <= x.taken <= 3 * x["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, filled([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))], 3)))
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    assert want["tiny"] == 3.0 and taken["empty"] == 0


def test_mix_of_no_documents_and_of_no_words(spark):
    schema = "doc_id long, source string, text string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert [x.taken for x in mix(spark.createDataFrame([(1, "a", ""), (2, None, None)], schema)).collect()] == [0, 0]
