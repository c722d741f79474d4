"""Texts that share too few bigrams with every licence end early, and lose nothing by it."""

import random
import time

import pytest
from pyspark.sql import functions as F

from murmur.llm import licenses as L


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_units_at_the_bounds_of_size_still_match(spark, threshold):
    words, more = [f"w{i}" for i in range(61)], [f"x{i}" for i in range(61)]
    for n in (1, 2, 3, 4, 6, 9, 12, 30, 60):
        known = [("T", " ".join(words[: n + 1]))]
        texts = [" ".join((words[: n + 1] + more)[: s + 1]) for s in range(2 * n + 1)]
        got = {r.text: [x.dice for x in r.licenses] for r in L.scan(spark.createDataFrame([(t,) for t in texts], "text string"), known=known, threshold=threshold).collect()}
        for s, t in enumerate(texts):
            dice = 2 * min(n, s) / (n + s)
            # beyond the bound a window holds the template
            assert got[t] == ([dice] if dice >= threshold else [1.0] if s > n else []), (n, s)


def test_a_licence_that_shows_only_after_a_unit_was_replaced_is_found(spark):
    known = [("A", "alpha beta gamma delta"), ("B", "one two three")]
    text = "alpha beta gamma delta\none two threealpha beta gamma delta"
    (row,) = L.scan(spark.createDataFrame([(text,)], "text string"), known=known).collect()
    assert {x.license for x in row.licenses} == {"A", "B"}


def test_texts_without_a_licence_cost_far_less_than_those_with_one(spark):
    r = random.Random(3)
    common = "of the and the in the to the is the that of the a or by with for any this".split()
    plain = ["\n".join(" ".join(r.choice(common) if r.random() < 0.3 else f"w{r.randrange(5000)}" for _ in range(40)) for _ in range(12)) for _ in range(1500)]
    line = "This work is licensed under the MIT License."
    taken = {}
    for name, texts in (("plain", plain), ("licensed", [f"{t}\n{line}" for t in plain])):
        df = L.scan(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2).cache())
        assert df.agg(F.sum(F.size("licenses"))).first()[0] == (0 if name == "plain" else len(texts))
        times = []
        for _ in range(4):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        taken[name] = min(times)
    assert taken["plain"] < 0.6 * taken["licensed"], taken
