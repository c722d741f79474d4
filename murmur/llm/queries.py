"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from murmur.llm import queries_manifest
from murmur.llm._common import read
from murmur.llm.decontaminate import decontaminate
from murmur.llm.imatch import fingerprint_pairs
from murmur.llm.jaccard_join import jaccard_components
from murmur.llm.licenses import scan
from murmur.llm.main_text import main_text
from murmur.llm.quality import resample
from murmur.llm.repeated_spans import cut_repeats
from murmur.llm.token_counts import count_tokens
from murmur.llm.warc import round_trip


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, as the tokenizer library counts them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    df = count_tokens(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return df.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record a page, read back from the archives."""
    df = round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and what they decode to, as digests."""
    return corpus_pipeline.tokens(spark, read(spark, sf_dir, "documents"), sf_dir)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight, Gumbel key and decision of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, read(spark, sf_dir, "labels")).select("doc_id", "log_weight", "gumbel_key", "kept")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    df = main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"), out_col="text")
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return fingerprint_pairs(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and least linked id of every document: 3-word shingles, Jaccard 0.9."""
    return jaccard_components(read(spark, sf_dir, "documents"), k=3, threshold="0.9")


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without windows of 35 words that occur elsewhere."""
    df = cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), k=35)
    return df.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they are of."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    df = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document."""
    df = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",")
    best = F.coalesce(F.array_max("licenses.dice"), F.lit(0.0))
    return df.select("doc_id", names.alias("licenses"), F.size("licenses").cast("long").alias("n_units"), best.alias("best_dice"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_byte_bpe, op4_quality, op5_main_text, op6_imatch, op7_jaccard_join, op8_repeated_spans, op9_decontaminate, op10_license_scan)}
QUERIES |= queries_manifest.QUERIES
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES: dict[str, str] = dict(queries_manifest.ORACLES)
ORACLES["op9_decontaminate"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bl AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
ORACLES["op2_warc"] = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m IS NOT NULL AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
ORACLES["op8_repeated_spans"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g JOIN r USING (h)) GROUP BY doc_id),
k AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN c USING (doc_id)),
x AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) t
  ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM c) z USING (doc_id, i) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN x ON k.doc_id = x.doc_id
"""
