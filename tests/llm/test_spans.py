"""Repeated spans against brute force: true counts, sources, maximal runs, however rows are dealt."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from murmur.llm import repeated_spans as R

K = 5


def corpus():
    r = random.Random(4)
    word = lambda: f"w{r.randrange(3000)}"
    shared = [" ".join(word() for _ in range(n)) for n in (5, 9, 30, 60)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(r.randrange(0, 25))) for _ in range(3)]
        for _ in range(r.choice([0, 1, 1, 2])):
            s = r.choice(shared).split()
            a = r.randrange(0, max(1, len(s) - 4))
            parts.insert(r.randrange(len(parts)), " ".join(s[a:] if r.random() < 0.4 else s))
        rows.append((i, " ".join(parts)))
    rows += [(200, "x y " * 20), (201, None), (202, ""), (203, " ".join(shared)), (204, f"{shared[2]}\n{shared[2]}"), rows[3], rows[3], (205, rows[3][1])]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_spans_have_true_counts_and_sources(spark, parts):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    keys = {(x.a, x.b): x.doc_id for x in df.select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b")).collect()}
    words = {i: (t or "").split() for i, t in rows}
    count, seen = Counter(), defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - K + 1):
            count[tuple(w[p : p + K])] += 1
            seen[tuple(w[p : p + K])].add((i, p))
    order = {i: k for k, i in keys.items()}
    want = {}
    for i, w in words.items():
        for p in range(len(w) - K + 1):
            win = tuple(w[p : p + K])
            if count[win] > 1:
                want[i, p] = (count[win], min((*order[j], q) for j, q in seen[win]))
    got = {}
    for x in R.repeated_spans(df, k=K).collect():
        i = keys[x.key1, x.key2]
        last = None
        for s in sorted(x.spans, key=lambda s: s["at"]):
            for d in range(s["n"]):
                assert (i, s["at"] + d) not in got
                got[i, s["at"] + d] = (s["count"], (s["source1"], s["source2"], s["source_at"] + d))
            if last and last["at"] + last["n"] == s["at"]:  # maximal: the next span differs in count or source
                assert (last["count"], last["source1"], last["source2"], last["source_at"] + last["n"]) != (s["count"], s["source1"], s["source2"], s["source_at"])
            last = s
    assert got == want


def test_workers_give_memory_back_after_each_batch(monkeypatch):
    import pyarrow as pa

    from murmur.llm import _words

    _words.give_back()
    calls = []
    monkeypatch.setattr(_words, "give_back", lambda: calls.append(1))
    batches = [pa.record_batch([pa.array(range(n))], ["a"]) for n in (5, 3)]
    assert [len(b) for b in _words.sliced(iter(batches), 2)] == [2, 2, 1, 2, 1] and len(calls) == 2


def counted(spark, monkeypatch):
    """An accumulator of the rows that _stretches makes."""
    made, of = spark.sparkContext.accumulator(0), R._stretches

    def stretches(batches):
        for b in of(batches):
            made.add(len(b))
            yield b

    monkeypatch.setattr(R, "_stretches", stretches)
    return made


def removed(rows, k):
    seen = Counter(tuple(t.split()[p : p + k]) for _, t in rows for p in range(len(t.split()) - k + 1))
    return {i: len({q for p in range(len(t.split()) - k + 1) if seen[tuple(t.split()[p : p + k])] > 1 for q in range(p, p + k)}) for i, t in rows}


def test_stretches_grow_no_faster_than_a_group_of_near_copies(spark, monkeypatch):
    """Each copy departs at another word, so counts change at more places the more copies there are."""
    made, rows = counted(spark, monkeypatch), []
    for g in (20, 80):
        r = random.Random(g)
        text = [f"w{i}" for i in range(400)]
        docs = []
        for i in range(g):
            at = r.randrange(400)
            docs.append((i, " ".join([*text[:at], f"x{i}", *text[at + 1 :]])))
        before = made.value
        got = R.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(g // 5), k=K).collect()
        assert {x.doc_id: x.n_removed for x in got} == removed(docs, K)
        rows.append(made.value - before)
    assert rows[1] < 6 * rows[0], rows


def test_a_cycle_is_one_path(spark, monkeypatch):
    """Words over and over, in either phase: a few stretches a document, not one for each round."""
    made = counted(spark, monkeypatch)
    docs = [(i, " ".join([f"a{i}"] + (["p", "q", "r"][i % 3 :] + ["p", "q", "r"] * 60)[: 150 + i] + [f"b{i}"] + ["z"] * (40 + i))) for i in range(30)]
    got = R.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), k=K).collect()
    assert {x.doc_id: x.n_removed for x in got} == removed(docs, K)
    assert made.value < 15 * len(docs), made.value


@pytest.mark.parametrize("parts", [1, 6])
def test_paths_lead_to_true_sources(spark, parts):
    r = random.Random(9)
    rows = corpus() + [(300 + i, " ".join(f"c{j % q}" for j in range(r.randrange(3, 60)))) for i, q in enumerate((1, 2, 2, 3, 3, 4, 7, 7, 7, 11))]
    rows += [(320 + i, " ".join(["u"] * r.randrange(0, 4) + [f"c{(j + i) % 3}" for j in range(50)] + ["v", "w"] * r.randrange(0, 9) + [f"c{j % 7}" for j in range(20)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    order = {x.doc_id: (x.a, x.b) for x in df.select("doc_id", F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b")).collect()}
    words, seen, count = {i: (t or "").split() for i, t in rows}, defaultdict(set), Counter()
    for i, t in rows:
        for p in range(len(words[i]) - K + 1):
            count[tuple(words[i][p : p + K])] += 1
            seen[tuple(words[i][p : p + K])].add((*order[i], p))
    want = {(*order[i], p): min(seen[win]) for i, w in words.items() for p in range(len(w) - K + 1) if count[win := tuple(w[p : p + K])] > 1}
    got = {}
    for x in R.repeated_spans(df, k=K, counts=False).collect():
        for s in x.spans:
            for d in range(s["n"]):
                assert (x.key1, x.key2, s["at"] + d) not in got
                got[x.key1, x.key2, s["at"] + d] = (s["source1"], s["source2"], s["source_at"] + d % s["period"])
    assert got == want
