"""Queries of comparisons, gates, run tables, label codes and serving joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalogue import _EF, query
from murmur.functions import scalars as S
from murmur.operators import matching, metrics, provenance, runs, studies
from murmur.sources import readers, sinks, waves
from murmur.sources.readers import table

_CMP = "(SELECT CASE WHEN event_type IN ('click', 'view') THEN 'synthetic' ELSE 'target' END AS side, event_type, value FROM events)"
_PCT = "(WITH s AS (SELECT value, sum(w) AS w FROM ({0}) GROUP BY value), c AS (SELECT value, sum(w) OVER (ORDER BY value) AS c, sum(w) OVER () AS t FROM s) SELECT share, min(value) FILTER (WHERE c >= t * share - 1e-12) AS value FROM c, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS share) GROUP BY share)"


@query(f"""SELECT share, s.value AS synthetic, n.value AS natural, u.value AS uniform, s.value - u.value AS delta
  FROM {_PCT.format(f"SELECT value, 1.0::DOUBLE AS w FROM {_CMP} WHERE side = 'synthetic'")} s JOIN {_PCT.format(f"SELECT value, 1.0::DOUBLE AS w FROM {_CMP} WHERE side = 'target'")} n USING (share)
  JOIN {_PCT.format(f"SELECT value, 1.0::DOUBLE / ((SELECT count(DISTINCT event_type) FROM {_CMP} WHERE side = 'target') * count(*) OVER (PARTITION BY event_type)) AS w FROM {_CMP} WHERE side = 'target'")} u USING (share)""")
def compared_percentiles(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type").isin("click", "view"), "synthetic").otherwise("target").alias("side"), "event_type", "value")
    return metrics.compared(e, "side", "event_type", "value", [0.1, 0.5, 0.9])


@query(f"""WITH RECURSIVE e AS {_EF}, n AS (SELECT clip, count(*) FILTER (WHERE ref) AS nr, count(*) FILTER (WHERE NOT ref) AS np FROM e GROUP BY clip),
  c AS (SELECT r.clip, r.id AS rid, p.id AS pid, (abs(r.t - p.t), r.t, p.t, r.id, p.id) AS k, abs(r.t - p.t) AS gap FROM e r JOIN e p ON r.clip = p.clip AND r.ref AND NOT p.ref AND abs(r.t - p.t) <= 36000 + 1e-9),
  m AS (SELECT clip, 0 AS step, []::BIGINT[] AS ur, []::BIGINT[] AS up, []::DOUBLE[] AS gaps FROM n
    UNION ALL SELECT m.clip, step + 1, list_append(any_value(ur), arg_min(rid, k)), list_append(any_value(up), arg_min(pid, k)), list_append(any_value(gaps), arg_min(gap, k)) FROM m JOIN c ON m.clip = c.clip AND NOT list_contains(ur, rid) AND NOT list_contains(up, pid) GROUP BY m.clip, step),
  t AS (SELECT clip, max(step) AS tp, arg_max(gaps, step) AS gaps FROM m GROUP BY clip), f AS (SELECT 2.0::DOUBLE * sum(tp) / nullif(sum(2 * tp + (np - tp) + (nr - tp)), 0) AS f1 FROM t JOIN n USING (clip)),
  g AS (SELECT quantile_cont(x, 0.5) AS median_shift FROM (SELECT unnest(gaps) AS x FROM t))
  SELECT f1, floor(median_shift * 1000 + 0.5) / 1000 AS median_shift, f1 >= 0.75 AND median_shift <= 0.1 AS passed FROM f, g""")
def agreement_gate(spark, d):
    """Event F1 and median shift of a user's views (reference) and clicks (predicted) of a day, ten hours apart at most."""
    e = table(spark, d, "events").where("event_type IN ('view', 'click')")
    rows = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("clip"), F.when(F.col("event_type") == "view", "reference").otherwise("predicted").alias("side"), (S.micros("ts") / 1e6).alias("onset"))
    pairs = matching.matched(rows, ["clip"], collar=36000.0)
    shifts = pairs.select(F.explode(F.array_repeat(F.greatest("reference", "predicted") - F.least("reference", "predicted"), F.col("n").cast("int"))).alias("shift"))
    out = metrics.gate(metrics.event_counts(rows, key=["clip"], collar=36000.0), shifts)
    return out.withColumn("median_shift", S.rounded("median_shift", 3))


@query("""SELECT coalesce(a.run, b.run) AS run, ece_n, ece_total, f1_n FROM (SELECT c_custkey AS run, n AS ece_n, total AS ece_total FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F') k LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n, round(sum(o_totalprice)) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (c_custkey)
    UNION ALL SELECT o_custkey, count(*), round(sum(o_totalprice)) FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1) a
  FULL JOIN (SELECT user_id AS run, count(*) AS f1_n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.run = b.run""")
def gathered_runs(spark, d):
    o = table(spark, d, "orders")
    base = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("run")).distinct()
    ece = o.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).alias("total"))
    f1 = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"))
    return provenance.gathered(base, {"ece": ece, "f1": f1})


@query("SELECT c_custkey AS run, coalesce(len(e), 0) AS epochs, coalesce(len(e) >= 12, false) AS complete FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey) AS e FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def runs_trained(spark, d):
    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.collect_list("o_orderkey").alias("epochs"))  # epochs of a run
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("run")).join(e, "run", "left")
    return provenance.trained(df, 12).select("run", F.coalesce(F.size("epochs"), F.lit(0)).alias("n"), "complete").select("run", F.greatest(F.lit(0), "n").cast("long").alias("epochs"), "complete")


@query("""WITH o AS (SELECT p_type AS name, max((p_partkey, p_name))[2] AS id FROM part GROUP BY p_type), i AS (SELECT o.id, l.code FROM (SELECT p_type AS name, p_size AS code FROM part GROUP BY ALL) l JOIN o USING (name))
  SELECT p_brand AS class_id, code, count(*) AS n FROM part JOIN i ON p_name = i.id GROUP BY ALL""")
def label_codes(spark, d):
    p = table(spark, d, "part")
    tax = p.select(F.col("p_brand").alias("class_id"), F.array("p_name").alias("audioset_ids"))
    labels = p.select(F.col("p_size").alias("code"), F.col("p_type").alias("name")).distinct()
    ontology = p.select(F.col("p_name").alias("id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("ordinal"))
    return readers.codes(tax, labels, ontology).groupBy("class_id", "code").agg(F.count("*").alias("n"))


_FR = "(SELECT user_id AS clip, CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'bad' ELSE 'good' END AS class_id, hour(ts) AS frame, max(least(value / 200, CAST(1 AS DOUBLE))) AS prob FROM events WHERE event_type <> 'signup' GROUP BY ALL)"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY clip, class_id ORDER BY frame) - 1 AS p, max(prob) OVER (PARTITION BY clip, class_id) AS peak, count(*) OVER (PARTITION BY clip, class_id) AS n FROM {_FR}),
  t AS (SELECT *, p - row_number() OVER (PARTITION BY clip, class_id ORDER BY p) AS i FROM f WHERE peak > 0 AND prob >= peak * 0.5),
  r AS (SELECT clip, class_id, i, min(p) AS s, max(p) + 1 AS e, any_value(n) AS n, any_value(peak) AS peak FROM t GROUP BY ALL),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, class_id ORDER BY e - s DESC, s) AS k FROM r) WHERE k = 1 AND peak >= 0.3),
  d AS (SELECT clip, class_id, floor(greatest(0.0, s * (10.0::DOUBLE / n) - 0.05) * 1000 + 0.5) / 1000 AS onset, floor(least(10.0, e * (10.0::DOUBLE / n) + 0.05) * 1000 + 0.5) / 1000 AS "offset", floor(peak * 10000 + 0.5) / 10000 AS confidence FROM b)
  SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY onset, class_id) - 1 AS INTEGER) AS ord, class_id, onset, "offset", confidence FROM d""")
def tagged_detections(spark, d):
    """Detections of users as clips of 10 s, hours as frames, event types as codes of two classes."""
    e = table(spark, d, "events").where("event_type <> 'signup'")
    f = e.groupBy(F.col("user_id").alias("clip"), F.col("event_type").alias("code"), F.hour("ts").alias("frame")).agg(F.max(F.least(F.col("value") / 200, F.lit(1.0))).alias("prob")).withColumn("duration", F.lit(10.0))
    codes = spark.createDataFrame([("bad", "error"), ("bad", "purchase"), ("good", "click"), ("good", "view")], "class_id string, code string")
    return runs.detections(f, codes, threshold=0.3)


@query("SELECT doc_id AS event_id, embedding IS NOT NULL AS has_vector, coalesce(len(embedding), -1) AS n FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def events_with_vectors(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.lit(None).cast("array<float>").alias("embedding"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), "embedding")
    return sinks.with_embeddings(e, v).select("event_id", F.col("embedding").isNotNull().alias("has_vector"), F.coalesce(F.size("embedding"), F.lit(-1)).cast("long").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/a ' || event_id ELSE strftime(ts + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M:%S') END AS shown FROM events")
def shown_times(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("n/a "), F.col("event_id").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", S.shown_time(text).alias("shown"))


@query("SELECT user_id AS event_id, event_type IN ('error', 'purchase') AS accepted, count(*) AS n FROM events WHERE user_id IN (SELECT o_custkey FROM orders) GROUP BY ALL UNION ALL SELECT user_id, NULL, count(*) FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def feedback_checked(spark, d):
    """Feedback split by whether its event exists."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("event_type").isin("error", "purchase").alias("accepted"))
    known, unknown = sinks.feedback(rows, table(spark, d, "orders").select(F.col("o_custkey").alias("event_id")).distinct())
    return known.groupBy("event_id", "accepted").agg(F.count("*").alias("n")).union(unknown.groupBy("event_id").agg(F.count("*").alias("n")).select("event_id", F.lit(None).cast("boolean"), "n"))


@query("""WITH c AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id)
  SELECT c_custkey AS clip, list_transform(['click', 'error', 'purchase', 'signup', 'view'], lambda x: CASE WHEN list_contains(coalesce(t, []), x) THEN 1 ELSE 0 END)::VARCHAR AS labels FROM customer LEFT JOIN c ON user_id = c_custkey""")
def clip_label_vectors(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_type").alias("class_id"))
    df = studies.label_vectors(e, table(spark, d, "customer").select(F.col("c_custkey").alias("clip")), ["clip"], ["click", "error", "purchase", "signup", "view"])
    return df.select("clip", F.concat(F.lit("["), F.array_join(F.col("labels").cast("array<string>"), ", "), F.lit("]")).alias("labels"))


@query("SELECT count(*) AS n_clips, count(DISTINCT l_partkey) AS n_videos FROM lineitem")
def distinct_videos(spark, d):
    return waves.source_videos(table(spark, d, "lineitem").select(F.col("l_partkey").alias("video_id")))


@query("SELECT o_orderpriority AS source, split, count(*) AS n FROM (SELECT *, ['train', 'dev', 'test'][o_custkey % 3 + 1] AS split FROM orders) WHERE split = 'train' OR (split = 'dev' AND o_orderpriority <> '1-URGENT') OR (split = 'test' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')) GROUP BY ALL")
def eligible_sources(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.get(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.col("o_custkey") % 3).cast("int")).alias("split"))
    every = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source")).distinct()
    rules = every.select("source", F.array_compact(F.array(F.lit("train"), F.when(F.col("source") != "1-URGENT", "dev"), F.when(F.col("source").isin("4-NOT SPECIFIED", "5-LOW"), "test"))).alias("splits"))
    return provenance.eligible(o, rules, "source", "split").groupBy("source", "split").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1")
def unmapped_names(spark, d):
    return provenance.unmapped(table(spark, d, "orders").select(F.col("o_custkey").alias("name")), table(spark, d, "events").select(F.col("user_id").alias("name")), "name")


@query("SELECT page_id AS id, sha256(coalesce(html, '')) AS digest FROM pages")
def content_digests(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
