"""Further queries over the driver's tables, with their SQL: serving plans, studies, inventories and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalogue import query
from murmur.functions import scalars as S
from murmur.operators import provenance, runs, studies
from murmur.plans import serving
from murmur.sources.readers import table


def _store(spark, d):
    """(events, detections, locations) as the serving plans take them."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("window_start"), F.col("user_id").cast("string").alias("location_id"), "event_type", (F.col("event_id") % 5).alias("_m"))
    events = e.select("event_id", "window_start", "location_id", F.when(F.col("_m") == 0, "").when(F.col("_m") > 1, F.concat(F.lit("/a/"), "event_id")).alias("audio_path"))
    o = table(spark, d, "lineitem")
    dets = o.select(F.col("l_orderkey").cast("string").alias("event_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("class_id"), F.col("l_quantity").alias("onset"), (F.col("l_quantity") + 1).alias("offset"), F.col("l_discount").alias("confidence"))
    places = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("location_id"), F.col("c_name").alias("name"))
    return events, dets, places


_CLASS_R = "event_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


@query(f"""SELECT CAST(e.event_id AS VARCHAR) AS event_id, c.c_name AS location, coalesce(n, 0) AS n_detections
  FROM (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND {_CLASS_R} ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 40 OFFSET 10) e
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = e.event_id LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def listing_page(spark, d):
    page, _ = serving.listing(*_store(spark, d), where=serving.filters(start="2024-01-02"), class_id="R", limit=40, offset=10)
    return page.select("event_id", "location", "n_detections")


@query(f"SELECT count(*) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND {_CLASS_R}")
def listing_total(spark, d):
    return serving.listing(*_store(spark, d), where=serving.filters(start="2024-01-02"), class_id="R")[1]


@query("""SELECT '7' AS event_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = 7) AS n, (SELECT string_agg(l_returnflag, ',' ORDER BY l_quantity, l_linenumber) FROM lineitem WHERE l_orderkey = 7) AS classes, true AS has_audio""")
def event_detail(spark, d):
    events, dets, _ = _store(spark, d)
    return serving.detail(events, dets, "7").select("event_id", F.size("detections").cast("long").alias("n"), F.array_join("detections.class_id", ",").alias("classes"), "has_audio")


@query("SELECT * FROM (VALUES ('5', 410, NULL), ('6', 410, NULL), ('7', 200, '/a/7'), ('none', 404, NULL)) t(event_id, status, audio_path)")
def audio_replay(spark, d):
    events = _store(spark, d)[0]
    out = [serving.replay(events, i) for i in ("5", "6", "7", "none")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT strftime(ts, '%Y%m%d') AS day, CAST(max(event_id % 1000 + 1) AS INTEGER) AS number FROM events GROUP BY 1")
def latest_numbers(spark, d):
    e = table(spark, d, "events").select(S.event_id("ts", (F.col("event_id") % 1000 + 1).cast("int")).alias("event_id"))
    return serving.latest_numbers(e.union(spark.createDataFrame([("EVT_2024_1",), (None,)], "event_id string")))


@query("SELECT event_id AS id, 'EVT_' || strftime(ts, '%Y%m%d') || '_' || lpad(CAST(event_id % 999999 + 1 AS VARCHAR), 6, '0') AS made, CAST(event_id % 999999 + 1 AS INTEGER) AS number FROM events")
def event_numbers(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), S.event_id("ts", (F.col("event_id") % 999999 + 1).cast("int")).alias("made"), F.date_format("ts", "yyyyMMdd").alias("day"))
    return e.select("id", "made", S.event_number("made", "day").alias("number"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS clip, CASE WHEN p > 0.9 THEN c ELSE '' END AS class_id, CASE WHEN p > 0.9 THEN p ELSE 0.0 END AS prob, CASE WHEN p > 0.9 THEN 'flagged' ELSE 'clean' END AS verdict
  FROM customer LEFT JOIN (SELECT user_id, max(least(value / 100, CAST(1 AS DOUBLE))) AS p, arg_max(event_type, (least(value / 100, CAST(1 AS DOUBLE)), event_type)) AS c FROM events GROUP BY 1) ON user_id = c_custkey""")
def contamination_verdicts(spark, d):
    frames = table(spark, d, "events").select(F.col("user_id").alias("clip"), F.col("event_type").alias("class_id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"))
    return provenance.contamination(frames, table(spark, d, "customer").select(F.col("c_custkey").alias("clip")), threshold=0.9)


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value / 3 < 0.1 THEN 'too_short' END, CASE WHEN value / 3 > 30 THEN 'too_long' END, CASE WHEN event_id % 50 / 2500.0::DOUBLE > 0.01 THEN 'clipped' END,
  CASE WHEN event_id % 50 / 2500.0::DOUBLE > 0.001 AND event_id % 50 / 2500.0::DOUBLE <= 0.01 THEN 'clipping_review' END, CASE WHEN event_id % 7 / 5000.0::DOUBLE < 0.001 THEN 'silent' END, CASE WHEN event_id % 3 * 8000 < 16000 THEN 'low_sample_rate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events""")
def quality_gates(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 3).alias("duration"), (F.col("event_id") % 50 / 2500.0).alias("clipped_ratio"), (F.col("event_id") % 7 / 5000.0).alias("rms"), (F.col("event_id") % 3 * 8000).alias("sample_rate"))
    return e.select("event_id", F.array_join(provenance.quality_reasons(), ",").alias("reasons"))


@query("SELECT count(*) AS n, max(l_quantity - 40) AS worst, arg_max(CAST(l_orderkey AS VARCHAR), (l_quantity - 40, CAST(l_orderkey AS VARCHAR))) AS worst_name FROM lineitem WHERE l_quantity - 40 > 0")
def boundary_overflow(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", F.lit(40.0).alias("duration"), F.col("l_orderkey").cast("string").alias("clip"))
    return provenance.overflow(rows, "l_quantity", "duration", "clip")


@query("""SELECT b.class_id, n_bank, n_target FROM (SELECT p_brand AS class_id, count(*) AS n_bank FROM part WHERE p_size >= 20 GROUP BY 1 HAVING count(*) >= 8) b
  JOIN (SELECT p_brand AS class_id, count(*) AS n_target FROM part WHERE p_retailprice >= 20 AND p_size % 2 = 0 GROUP BY 1) t USING (class_id)""")
def long_event_supply(spark, d):
    p = table(spark, d, "part")
    return provenance.long_event_classes(p.select(F.col("p_brand").alias("class_id"), F.col("p_size").cast("double").alias("eff")), p.where("p_size % 2 = 0").select(F.col("p_brand").alias("class_id"), F.col("p_retailprice").alias("duration")), 20.0)


_Q = "floor(quantile_cont({}, {}) * 1000000 + 0.5) / 1000000"


@query(f"""SELECT count(*) AS n, {_Q.format('value', 0.1)} AS eff_10, {_Q.format('value', 0.5)} AS eff_50, {_Q.format('value', 0.9)} AS eff_90, max(value) AS eff_max, {_Q.format('event_id % 100 / 100.0::DOUBLE', 0.9)} AS lead_90,
  count(*) FILTER (WHERE event_id % 100 / 100.0::DOUBLE > 0.5) AS late, count(*) FILTER (WHERE value >= 8) AS n_2, count(DISTINCT event_type) FILTER (WHERE value >= 8) AS classes_2 FROM events WHERE event_id % 10 <> 0""")
def bank_percentiles(spark, d):
    b = table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, "broken").alias("loi"), F.col("value").alias("eff"), (F.col("event_id") % 100 / 100.0).alias("lead"), F.col("event_type").alias("class_id"))
    r = provenance.bank_summary(b)
    return r.select("n", *[S.rounded(F.col("eff")[i], 6).alias(f"eff_{n}") for i, n in ((0, 10), (1, 50), (2, 90))], "eff_max", S.rounded(F.col("lead")[1], 6).alias("lead_90"), "late", "n_2", "classes_2")


@query("""WITH s AS (SELECT user_id, hour(ts) AS seg, max(value) AS value FROM events GROUP BY ALL), m AS (SELECT *, max(seg) OVER (PARTITION BY user_id) AS last FROM s)
  SELECT user_id, CAST(unnest(range(seg * 4, CASE WHEN seg = last THEN 100 ELSE seg * 4 + 4 END)) AS INTEGER) AS frame, value FROM m""")
def frame_rebuild(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("seg")).agg(F.max("value").alias("prob"))
    return runs.rebuild_frames(s, ["user_id"], per_segment=4, n_frames=100)


@query("SELECT user_id, event_type AS class_id, min(value) AS onset FROM events GROUP BY ALL")
def clip_classes(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("event_label"), F.col("value").alias("onset"))
    return studies.clip_classes(e, ["user_id"])


@query("SELECT c_mktsegment AS area_type, count(*) AS n, floor(sum(c_acctbal) / 60 * 1000 + 0.5) / 1000 AS minutes FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1")
def background_areas(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("area_type"), F.col("c_acctbal").alias("duration"), F.when(F.col("c_nationkey") % 3 == 0, "clean").when(F.col("c_nationkey") % 3 == 1, "flagged").alias("verdict"))
    return studies.background_by_area(c).withColumn("minutes", S.rounded("minutes", 3))


@query("""SELECT split, count(*) AS n, floor(sum(duration) / 60 * 1000 + 0.5) / 1000 AS minutes FROM (SELECT event_id AS file_id, CASE event_type WHEN 'view' THEN 'dev' WHEN 'click' THEN 'gold_test' ELSE 'train' END AS split FROM events)
  JOIN (SELECT o_orderkey AS file_id, o_totalprice AS duration FROM orders) USING (file_id) WHERE split IN ('dev', 'gold_test') GROUP BY split""")
def split_inventory(spark, d):
    s = table(spark, d, "events").select(F.col("event_id").alias("file_id"), F.when(F.col("event_type") == "view", "dev").when(F.col("event_type") == "click", "gold_test").otherwise("train").alias("split"))
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_totalprice").alias("duration"))
    return studies.split_summary(s, m).withColumn("minutes", S.rounded("minutes", 3))


@query("SELECT user_id AS run, count(*) FILTER (WHERE value >= 50) AS n_ref, count(*) FILTER (WHERE value >= 50 AND event_type = 'error') AS fragmented, count(*) FILTER (WHERE value >= 50 AND event_type = 'error')::DOUBLE / nullif(count(*) FILTER (WHERE value >= 50), 0) AS long_ratio FROM events GROUP BY 1")
def long_event_ratio(spark, d):
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count_if(F.col("value") >= 50).alias("n_ref"), F.count_if((F.col("value") >= 50) & (F.col("event_type") == "error")).alias("fragmented"))
    return studies.long_event_ratio(r)


@query("SELECT f AS fragmented, count(v) AS n, median(v) AS median FROM (VALUES (true), (false)) t(f) LEFT JOIN (SELECT event_type = 'error' AS g, floor(value * 100) AS v FROM events WHERE value >= 20) ON f = g GROUP BY f")
def gap_groups(spark, d):
    e = table(spark, d, "events").withColumn("gap", F.floor(F.col("value") * 100).cast("double"))
    return studies.gap_summary(e, F.col("event_type") == "error", "gap", least=F.col("value") >= 20)


_SIDE = "(SELECT user_id, event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'reference' ELSE 'predicted' END AS side, event_type AS class_id, epoch_us(ts) / 1000000.0::DOUBLE AS onset, epoch_us(ts) / 1000000.0::DOUBLE + 1 + value * 600 AS \"offset\" FROM events)"


def _sides(spark, d):
    t = S.micros("ts") / 1e6
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "reference").otherwise("predicted").alias("side"), F.col("event_type").alias("class_id"), t.alias("onset"), (t + 1 + F.col("value") * 600).alias("offset"))


@query(f"""WITH a AS (SELECT user_id, side, unnest(range(CAST(floor(onset / 600) AS BIGINT), greatest(CAST(floor(onset / 600) AS BIGINT), CAST(ceil("offset" / 600) AS BIGINT) - 1) + 1)) AS seg FROM {_SIDE}),
  g AS (SELECT user_id, seg, bool_or(side = 'reference') AS r, bool_or(side = 'predicted') AS p FROM a GROUP BY ALL)
  SELECT user_id, count(*) FILTER (WHERE r AND p) AS tp, count(*) FILTER (WHERE NOT r AND p) AS fp, count(*) FILTER (WHERE r AND NOT p) AS fn FROM g GROUP BY 1""")
def segment_agreement(spark, d):
    return studies.segment_counts(_sides(spark, d), ["user_id"], length=600.0)


@query(f"""WITH s AS {_SIDE}, p AS (SELECT r.id AS rid, q.id AS pid, r.class_id = q.class_id AS same, abs(r.onset - q.onset) <= 3600 AND abs(r."offset" - q."offset") <= 3600 AS close FROM s r JOIN s q ON r.user_id = q.user_id AND r.side = 'reference' AND q.side = 'predicted' AND r.onset < q."offset" AND q.onset < r."offset"),
  a AS (SELECT rid, bool_or(same AND close) AS hit, bool_or(same) AS near, count(*) FILTER (WHERE same) AS parts FROM p GROUP BY rid), b AS (SELECT pid, count(*) FILTER (WHERE same) AS wholes FROM p GROUP BY pid)
  SELECT kind, count(*) AS n FROM (SELECT CASE WHEN rid IS NULL THEN 'deletion' WHEN hit THEN 'correct' WHEN near THEN 'boundary' ELSE 'substitution' END AS kind FROM s LEFT JOIN a ON rid = id WHERE side = 'reference'
  UNION ALL SELECT 'fragmentation' FROM a WHERE parts > 1 UNION ALL SELECT 'insertion' FROM s LEFT JOIN b ON pid = id WHERE side = 'predicted' AND pid IS NULL UNION ALL SELECT 'merge' FROM b WHERE wholes > 1) GROUP BY kind""")
def error_kinds(spark, d):
    return studies.error_kinds(_sides(spark, d), ["user_id"], bucket=7200.0, collar=3600.0)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def sources_apart(spark, d):
    return studies.apart(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("video")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("video")), "video").select("o_orderkey")


@query("""SELECT event_id, floor(20 * log10(greatest(value / 100, 1e-10)) * 1000000 + 0.5) / 1000000 AS db, CAST(greatest(-32767, least(32767, round_even((value / 50 - 1) * 32767, 0))) AS SMALLINT) AS i16,
  CAST(greatest(1, round_even(1001 * least(1.0::DOUBLE, value * 16000 / 160000), 0)) AS INTEGER) AS frames, least(100.0::DOUBLE, greatest(0.0::DOUBLE, hour(ts) / 20.0::DOUBLE * 100)) AS edge,
  least(100.0::DOUBLE - least(100.0::DOUBLE, greatest(0.0::DOUBLE, hour(ts) / 20.0::DOUBLE * 100)), greatest(2.0::DOUBLE, value / 20.0::DOUBLE * 100)) AS width FROM events""")
def signal_scalars(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.hour("ts").cast("double").alias("onset"))
    left, width = S.bar("onset", F.col("value") + F.col("onset"), F.lit(20.0))
    width = S.bar(F.lit(0.0), "value", F.lit(20.0))[1]
    return e.select("event_id", S.rounded(S.decibel(F.col("value") / 100), 6).alias("db"), S.as_int16(F.col("value") / 50 - 1).alias("i16"), S.real_frames(F.lit(1001), "value", 16000, F.lit(160000)).alias("frames"), left.alias("edge"), F.least(F.lit(100.0) - left, width).alias("width"))


@query("""SELECT p_partkey, p_brand || '/' || p_name AS path, p_brand || '|' || p_name AS parts, translate(format('{:,.2f}', p_retailprice), ',.', '.,') AS price FROM part""")
def text_scalars(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", S.relative_path(F.concat(F.lit("data\\raw\\"), "p_brand", F.lit("\\"), "p_name"), "data/raw/").alias("path"), F.array_join(S.split_list(F.concat(F.lit(" ,"), "p_brand", F.lit("; ,"), "p_name", F.lit(" ;"))), "|").alias("parts"), S.comma_decimal("p_retailprice", 2).alias("price"))


@query("""SELECT vec_id, floor(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * 1000000 + 0.5) / 1000000 AS x, 150 AS n, embedding[22] = embedding[22] AS again FROM embeddings""")
def vector_scalars(spark, d):
    e = table(spark, d, "embeddings")
    t = S.tiled(S.checked_vector("embedding", 64), 150)
    return e.select("vec_id", S.rounded(F.col("embedding").isNotNull().cast("int") * S.l2_normalised("embedding")[0], 6).alias("x"), F.size(t).alias("n"), (t[149] == F.col("embedding")[21]).alias("again"))



@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS w FROM documents)
  SELECT a.doc_id, floor(len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) * 1e8 + 0.5) / 1e8 AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def next_text_alike(spark, d):
    """How alike the whole texts of each document and the one of the next id are."""
    t = table(spark, d, "documents").select("doc_id", "text")
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return t.join(other, "doc_id").select("doc_id", S.rounded(S.token_jaccard("text", "next"), 8).alias("jaccard"))


@query("""WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY CAST('0x' || substr(sha256('7:' || c_custkey), 1, 15) AS BIGINT), c_custkey) AS r, count(*) OVER () AS n FROM customer)
  SELECT c_custkey, r <= greatest(1, round_even(n * 0.1, 0)) AS validation FROM h""")
def random_split_share(spark, d):
    return provenance.random_split(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.1, 7)
