"""A band of more than 2^20 terms stays an array, so that terms of texts are not moved."""

import pytest

pytest.importorskip("murmur.llm")

from murmur.llm import imatch
from pyspark.sql import functions as F


def test_a_large_band_is_an_array_of_few_bytes_a_term(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(5499)), lambda j: F.concat_ws("x", F.floor(F.col("id") / 2).cast("string"), j.cast("string")))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))  # each term in two texts
    lex = imatch.lexicon(docs)
    assert isinstance(lex, imatch.Table)
    (size,) = lex.rows.select(F.size("t")).first()
    assert 200 * 5500 > 1 << 20 and size < 1.3 * 200 * 5500
    df = imatch.with_fingerprint(docs.where("doc_id < 6"), F.col("text"), lex, "f")
    got = {r.doc_id: r.f for r in df.select("doc_id", "f").collect()}
    assert got[0] == got[1] != got[2] == got[3] and imatch.EMPTY not in got[4]
