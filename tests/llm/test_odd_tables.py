"""Every operator on odd tables: clashing column names, repeated rows, nulls, very long texts, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from murmur.llm import byte_bpe, decontaminate, imatch, jaccard_join, licenses, main_text, quality, repeated_spans, token_counts, warc

#: Names that the operators use for columns of their own, or results are called by other operators.
NAMES = "once_ _once_ words_ band_ name_ found_ block_ spot_ key_ k s q w h i p t id d l j node comp cls digest first text_key_ hits_key_ window_ licenses_text_ licenses_words_ licenses_hits_ licenses_found_ key1_ key2_ spans_ res_ maybe_ gone_ Window Item len at".split()
ANSWER = "An answer of eleven plain words which the benchmark holds too, twice."


def _bpe(df):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.decode(byte_bpe.encode(df, ranks, public_tokenizers.PATTERN, common=100), ranks)


def _labels(df):
    return df.sparkSession.createDataFrame([(1, 1), (2, 0), (5, 1), (6, 0)], "doc_id long, quality int")


def _bench(df):
    return df.sparkSession.createDataFrame([(1, ANSWER), (None, None), (3, "")], "item_id long, text string")


ROWS = {
    "op1": lambda df: token_counts.count_tokens(df, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN),
    "op3": _bpe,
    "op4": lambda df: quality.resample(df, _labels(df)),
    "op5": lambda df: main_text.main_text(df, "text"),
    "op8": lambda df: repeated_spans.cut_repeats(df, k=8),
    "op9": lambda df: decontaminate.decontaminate(df, _bench(df)),
    "op10": lambda df: licenses.scan(df),
}
#: Those that return rows of their own.
OTHERS = {
    "op2": lambda df: warc.round_trip(df.select("*", F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
    "op6": imatch.fingerprint_pairs,
    "op7": lambda df: jaccard_join.jaccard_components(df, k=3, threshold="0.9"),
}
TEXTS = [(1, ANSWER), (1, ANSWER), (2, None), (3, ""), (None, ANSWER), (4, " \n\t"), (5, "Released under the MIT License."), (6, "é" * 3000 + " <b>x</b> " + "many words again and again " * 6000), (7, "x" * 4000)]


def odd(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


@pytest.mark.parametrize("name", ROWS)
def test_clashing_names_and_repeated_rows(spark, name):
    df = odd(spark, TEXTS)
    got = ROWS[name](df)
    assert [c for c in df.columns if c not in got.columns] == []
    keys = ["doc_id", *NAMES[:3], "q", "k", "s", "licenses_text_"]
    want = sorted(df.select(*keys).collect(), key=str)
    assert sorted(got.select(*keys).collect(), key=str) == want
    plain = spark.createDataFrame(TEXTS, "doc_id long, text string")
    new = [c for c in ROWS[name](plain).columns if c not in plain.columns]
    same = lambda d: sorted(map(str, d.select("doc_id", *new).collect()))
    assert same(got) == same(ROWS[name](plain))
    assert len({str(r) for r in got.where("doc_id = 1").select(*new).collect()}) == 1


@pytest.mark.parametrize("name", OTHERS)
def test_other_columns_take_no_part(spark, name):
    got = sorted(map(str, OTHERS[name](odd(spark, TEXTS)).collect()))
    assert len(got) == len(TEXTS) and got == sorted(map(str, OTHERS[name](spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()))


@pytest.mark.parametrize("name", {**ROWS, **OTHERS})
def test_no_rows(spark, name):
    assert {**ROWS, **OTHERS}[name](odd(spark, TEXTS).limit(0)).count() == 0


def test_decontamination_beyond_the_literal(spark, monkeypatch):
    want = sorted(map(str, ROWS["op9"](odd(spark, TEXTS)).collect()))
    monkeypatch.setattr(decontaminate, "MAX_LITERAL", 0)
    assert sorted(map(str, ROWS["op9"](odd(spark, TEXTS)).collect())) == want
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert sorted(map(str, ROWS["op9"](odd(spark, TEXTS)).collect())) == want


def test_blocks_of_the_order_are_found_without_fingerprints(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"the text of document {i} and {i % 7}"

    docs = spark.range(500).select(F.col("id").alias("doc_id"), text("id").alias("text"))
    df = imatch.fingerprint_pairs(docs)
    assert seen.value <= 500  # the count of terms alone reads texts before the result is asked for
    assert df.count() == 500
