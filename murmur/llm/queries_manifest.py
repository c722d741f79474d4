"""The registered queries of the Merkle manifest, the prefix trie and the mix, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm._common import read
from murmur.llm.merkle import tampered_manifest
from murmur.llm.mixing import mix
from murmur.llm.prefix_trie import prefix_trie


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, folded from a copy without line breaks in every other text."""
    return tampered_manifest(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of weights 1, 2, 3 by source takes."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op11_merkle, op12_prefix_trie, op13_mix)}

#: crc32 of the decimal digits of {0}, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

ORACLES: dict[str, str] = {}
ORACLES["op11_merkle"] = f"""
WITH RECURSIVE l AS (SELECT doc_id, source, {_LEAF.format('text')} AS leaf, CASE WHEN {_CRC.format('doc_id')} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS cut FROM documents),
p AS (SELECT *, coalesce('=' || source, '') AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT k, 0 AS lvl, p AS i, leaf AS d, n FROM p UNION ALL SELECT k, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY k, lvl, i // 3),
s AS (SELECT k, d AS subroot, row_number() OVER (ORDER BY k) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, p AS i, subroot AS d, n FROM s UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, i // 3),
g AS (SELECT p.k, p.p, x.lvl, string_agg(y.d, '' ORDER BY y.i) FILTER (WHERE y.i < x.i) AS a, string_agg(y.d, '' ORDER BY y.i) FILTER (WHERE y.i > x.i) AS b
  FROM p JOIN t x ON x.k = p.k AND x.n > 1 AND x.i = p.p // CAST(power(3, x.lvl) AS BIGINT) JOIN t y ON y.k = x.k AND y.lvl = x.lvl AND y.i // 3 = x.i // 3 GROUP BY p.k, p.p, x.lvl),
h AS (SELECT s.k, x.lvl, string_agg(y.d, '' ORDER BY y.i) FILTER (WHERE y.i < x.i) AS a, string_agg(y.d, '' ORDER BY y.i) FILTER (WHERE y.i > x.i) AS b
  FROM s JOIN u x ON x.n > 1 AND x.i = s.p // CAST(power(3, x.lvl) AS BIGINT) JOIN u y ON y.lvl = x.lvl AND y.i // 3 = x.i // 3 GROUP BY s.k, x.lvl),
w AS (SELECT k, p, row_number() OVER (PARTITION BY k, p ORDER BY part, lvl) - 1 AS z, coalesce(a, '') AS a, coalesce(b, '') AS b FROM (SELECT k, p, 0 AS part, lvl, a, b FROM g UNION ALL SELECT p.k, p.p, 1, h.lvl, h.a, h.b FROM p JOIN h ON h.k = p.k)),
f AS (SELECT k, p, 0 AS z, coalesce(cut, leaf) AS d FROM p UNION ALL SELECT f.k, f.p, f.z + 1, sha256(w.a || f.d || w.b) FROM f JOIN w ON w.k = f.k AND w.p = f.p AND w.z = f.z),
q AS (SELECT k, p, arg_max(d, z) AS folded FROM f GROUP BY k, p),
o AS (SELECT k, p, sha256(string_agg(a || b, '' ORDER BY z)) AS proof FROM w GROUP BY k, p)
SELECT p.doc_id, p.leaf, s.subroot, r.d AS root, coalesce(o.proof, sha256('')) AS proof_sha256, q.folded AS folded_root, q.folded = r.d AS verified
FROM p JOIN s ON s.k = p.k JOIN q ON q.k = p.k AND q.p = p.p LEFT JOIN o ON o.k = p.k AND o.p = p.p, (SELECT d FROM u WHERE n = 1) r
"""

ORACLES["op13_mix"] = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, sha256('0:' || coalesce(CAST(doc_id AS VARCHAR), ''))[:16] AS draw FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS size, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM d GROUP BY k),
r AS (SELECT *, size * 3 AS cap, (size * 3) / w AS ratio, sum(size) OVER () AS total, sum(w) OVER () AS weights FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before FROM r WINDOW o AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total::DOUBLE - cap_before::DOUBLE) / (weights - w_before)::DOUBLE AS level FROM b),
t AS (SELECT k, size, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE (SELECT arg_min(level, (ratio, k)) FROM l WHERE ratio > level) * w END AS target FROM l),
c AS (SELECT d.*, t.size AS source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY draw, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken FROM c
"""

ORACLES["op12_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id AS c, left(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS g, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS i FROM t),
h AS (SELECT DISTINCT c, c - c % 20 AS base, {_CRC.format('c')} % 4 AS h FROM t),
r AS (SELECT h.c, 0 AS part, i.i, g, w FROM h JOIN i ON i.c = h.base AND i.i <= h.h UNION ALL SELECT h.c, 1, i.i, g, w FROM h JOIN i ON i.c = h.c AND i.i > h.h),
d AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM r),
q AS (SELECT c, d, w, sha256(string_agg(g, ',') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS id FROM d UNION ALL SELECT c, 0, 0, '' FROM h),
e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last, lag(id) OVER (PARTITION BY c ORDER BY d) AS up FROM q),
n AS (SELECT d, id, min(c) AS conv_id, count(*) AS n, any_value(w) AS w, any_value(up) AS up, bool_and(last) AS leaf, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS sha FROM e GROUP BY d, id),
s AS (SELECT DISTINCT x.d, x.id, y.d AS d2, y.id AS id2 FROM e x JOIN e y ON x.c = y.c AND y.d >= x.d),
v AS (SELECT s.d, s.id, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum((n - 1) * w) AS BIGINT) AS saved FROM s JOIN n ON n.d = s.d2 AND n.id = s.id2 GROUP BY s.d, s.id),
k AS (SELECT d - 1 AS d, up AS id, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n_children, 0) AS n_children, v.n_leaves, v.saved AS saved_tokens, n.sha AS ends_sha256
FROM n JOIN v ON v.d = n.d AND v.id = n.id LEFT JOIN k ON k.d = n.d AND k.id = n.id LEFT JOIN n p ON p.d = n.d - 1 AND p.id = n.up
"""
