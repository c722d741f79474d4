"""Licence windows in long and edited texts."""

import random
import time

import pytest

from murmur.llm import licenses as L


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(text, every, seed=1):
    w = L.normalised(text)
    r = random.Random(seed)
    return [f"changed{r.randrange(10**6)}" if i % every == every - 1 else x for i, x in enumerate(w)]


def found(spark, text, known=None):
    (row,) = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), known=known).collect()
    return row.licenses


def test_each_planted_licence_is_found_in_a_long_text(spark):
    known = dict(L.templates())
    names = sorted(known, key=lambda n: -len(known[n]))[:1] + [n for n in known if 100 < len(L.normalised(known[n])) < 400][:3]
    parts = []
    for i, n in enumerate(names):
        parts += words(300, i) + L.normalised(known[n])
    got = {x.license for x in found(spark, " ".join(parts + words(300, 99)))}
    assert set(names) <= got


def test_windows_equal_brute_force_for_one_template(spark):
    r = random.Random(7)
    template = " ".join(words(60, 5))
    grams = set(L.bigrams(L.normalised(template)))
    for trial in range(6):
        body = edited(template, r.choice([9, 12, 20, 61]), trial)
        if trial % 3 == 0:
            body[30:30] = words(r.randrange(1, 6), trial + 50)
        text = " ".join(words(r.randrange(0, 120), trial + 100) + body + words(r.randrange(0, 120), trial + 200))
        w = L.normalised(text)
        best = 0.0
        for a in range(len(w)):
            for z in range(a + 2, min(len(w), a + 100) + 1):
                g = set(L.bigrams(w[a:z]))
                best = max(best, 2 * len(g & grams) / (len(g) + len(grams)))
        got = max((x.dice for x in found(spark, text, [("T", template)])), default=0.0)
        assert got <= best + 1e-12
        if best >= L.THRESHOLD + 0.06:
            assert got >= L.THRESHOLD and got >= best - 0.1, (trial, got, best)


@pytest.mark.parametrize("times", [1, 2])
def test_a_long_edited_licence_ends_soon(spark, times):
    text = max(dict(L.templates()).values(), key=len)
    long = " ".join(" ".join(edited(text, 15, seed)) + " " + " ".join(words(200, seed)) for seed in range(times))
    while len(long.split()) < 11_000 * times and len(long.split()) < 20_000:
        long += " " + " ".join(edited(text, 15, len(long))) + " " + " ".join(words(200, len(long)))
    began = time.time()
    got = found(spark, long)
    assert time.time() - began < 40 and got
