"""Queries of operators that work in rounds or stretches, with their SQL: placement, filters by class, gap study, slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.catalogue import _EF, _I, HOUR, query, spans
from murmur.functions import scalars as S
from murmur.operators import metrics, placement, runs, studies
from murmur.sources.readers import table

_U = "CAST('0x' || substr(sha256('3:' || {0} || ':' || user_id || ':' || user_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
_LONG = f"(user_id % 11 * {36 * HOUR})"


@query(f"""WITH i AS {_I}, c AS (SELECT user_id, min(s) AS lo, max(e) AS hi, {_LONG} AS len FROM i GROUP BY user_id),
  r AS (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE e > s),
  g AS (SELECT user_id, reach AS g0, s AS g1 FROM r WHERE reach < s),
  f AS (SELECT user_id, g0, g1 - g0 AS gap, len, sum(g1 - g0) OVER (PARTITION BY user_id ORDER BY g0) - (g1 - g0) AS before, sum(g1 - g0) OVER (PARTITION BY user_id) AS total FROM g JOIN c USING (user_id) WHERE g1 - g0 >= len),
  h AS (SELECT user_id, CAST(g0 + floor({_U.format(1)} * (gap - len + 1)) AS BIGINT) AS s, len FROM f WHERE before <= floor({_U.format(0)} * total) AND floor({_U.format(0)} * total) < before + gap),
  t AS (SELECT user_id, k, CAST(lo + floor({_U.format('(k + 2)')} * (greatest(hi - lo - len, 0) + 1)) AS BIGINT) AS s, len FROM c, (SELECT unnest(range(16)) AS k) WHERE user_id NOT IN (SELECT user_id FROM h)),
  m AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM r) GROUP BY user_id, g),
  o AS (SELECT t.user_id, k, any_value(t.s) AS s, any_value(len) AS len, CAST(coalesce(sum(least(t.s + len, m.e) - greatest(t.s, m.s)), 0) AS BIGINT) AS overlap FROM t LEFT JOIN m ON m.user_id = t.user_id AND m.s < t.s + len AND t.s < m.e GROUP BY t.user_id, k),
  b AS (SELECT user_id, min((overlap, k, s, len)) AS x FROM o GROUP BY user_id)
  SELECT user_id, s AS "start", s + len AS "end", true AS fits, 0::BIGINT AS overlap FROM h UNION ALL SELECT user_id, x[3], x[3] + x[4], false, x[1] FROM b""")
def free_placement(spark, d):
    """One event a user, of 0 to 15 days, into what the user's events leave free."""
    i = spans(spark, d)
    clips = i.groupBy("user_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    new = clips.select("user_id", F.col("user_id").alias("id"), (F.col("user_id") % 11 * (36 * HOUR)).alias("length"))
    return placement.place(new, i.select("user_id", "start", "end"), clips, ["user_id"], id_col="id", width=24 * HOUR, seed=3).drop("id")


_K = "(SELECT event_id, 'c' || user_id % 4 AS class_id, ts, value, value * (1 + user_id % 4 * 4) AS length FROM events)"


@query(f"""WITH k AS {_K}, q AS (SELECT class_id, least(51, greatest(1, floor(quantile_cont(length, 0.25) / 4))) AS n FROM k GROUP BY class_id),
  w AS (SELECT class_id, CAST(CASE WHEN n % 2 = 0 THEN n - 1 ELSE n END AS INTEGER) AS width FROM q),
  r AS (SELECT event_id, k.class_id, width, width // 2 AS h, row_number() OVER (PARTITION BY k.class_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY k.class_id) AS n,
    list(value) OVER (PARTITION BY k.class_id ORDER BY ts, event_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS near FROM k JOIN w USING (class_id)),
  s AS (SELECT event_id, class_id, width, list_sort(near[greatest(1, i - h) - greatest(1, i - 25) + 1 : least(n, i + h) - greatest(1, i - 25) + 1]) AS v FROM r)
  SELECT event_id, class_id, width, v[len(v) // 2 + 1] AS median FROM s""")
def median_filter_by_class(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("class_id"), "ts", "value", (F.col("value") * (1 + F.col("user_id") % 4 * 4)).alias("length"))
    w = runs.widths(e, "class_id", "length", step=4.0)
    rows = e.join(F.broadcast(w), "class_id")  # a row a class of the vocabulary
    return runs.median_filter_by(rows, ["class_id"], ["ts", "event_id"], "value", "width", F.date_trunc("hour", "ts")).select("event_id", "class_id", "width", "median")


_T = "epoch_us(ts) / 1000000.0::DOUBLE"
_GS = f"""WITH r AS (SELECT event_id AS id, user_id, event_type AS class_id, {_T} AS onset, {_T} + value * 3600 AS "offset" FROM events WHERE event_type IN ('view', 'purchase') AND value >= 50),
  p AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'view' WHEN 'signup' THEN 'purchase' ELSE event_type END AS class_id, {_T} AS onset, {_T} + value * 3600 AS "offset" FROM events WHERE event_type IN ('click', 'signup')),
  l AS (SELECT r.id, CAST(floor(({_T} - onset) / 7200) AS BIGINT) AS hop, sqrt(avg(e.value * e.value)) AS rms FROM r JOIN events e ON e.user_id = r.user_id AND {_T} >= onset AND {_T} < "offset" GROUP BY ALL),
  m AS (SELECT *, rms < quantile_cont(rms, 0.5) OVER (PARTITION BY id) * 0.5 AS quiet, row_number() OVER (PARTITION BY id ORDER BY hop) AS i FROM l),
  g AS (SELECT id, max(n) AS n FROM (SELECT id, count(*) AS n FROM (SELECT id, i - row_number() OVER (PARTITION BY id ORDER BY i) AS b FROM m WHERE quiet) GROUP BY id, b) GROUP BY id),
  f AS (SELECT r.id, count(*) AS n FROM r JOIN p ON p.user_id = r.user_id AND p.class_id = r.class_id AND p.onset < r."offset" AND r.onset < p."offset" GROUP BY r.id)"""


@query(f"{_GS} SELECT id, class_id, coalesce(f.n, 0) >= 2 AS fragmented, CASE WHEN id IN (SELECT id FROM l) THEN coalesce(g.n, 0) * 7200.0::DOUBLE END AS gap FROM r LEFT JOIN f USING (id) LEFT JOIN g USING (id)")
def long_event_gaps(spark, d):
    """Long views and purchases, the values of the user's events as their sound, clicks and signups as predictions."""
    t = S.micros("ts") / 1e6
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("class_id"), t.alias("onset"), (t + F.col("value") * 3600).alias("offset"))
    reference = rows.where("class_id IN ('view', 'purchase')")
    predicted = rows.where("class_id IN ('click', 'signup')").withColumn("class_id", F.when(F.col("class_id") == "click", "view").otherwise("purchase"))
    sounds = e.select("user_id", t.alias("at"), F.col("value").alias("x"))
    return studies.long_event_gaps(reference, predicted, sounds, ["user_id"], id_col="id", hop=7200.0, bucket=86400.0, share=0.5, least=50 * 3600.0)


_GREEDY = f"""WITH RECURSIVE e AS {_EF}, n AS (SELECT clip, count(*) FILTER (WHERE ref) AS nr, count(*) FILTER (WHERE NOT ref) AS np FROM e GROUP BY clip),
  c AS (SELECT r.clip, r.id AS rid, p.id AS pid, (abs(r.t - p.t), r.t, p.t, r.id, p.id) AS k FROM e r JOIN e p ON r.clip = p.clip AND r.ref AND NOT p.ref AND abs(r.t - p.t) <= 3600 + 1e-9),
  m AS (SELECT clip, 0 AS step, []::BIGINT[] AS ur, []::BIGINT[] AS up FROM n
    UNION ALL SELECT m.clip, step + 1, list_append(any_value(ur), arg_min(rid, k)), list_append(any_value(up), arg_min(pid, k)) FROM m JOIN c ON m.clip = c.clip AND NOT list_contains(ur, rid) AND NOT list_contains(up, pid) GROUP BY m.clip, step),
  t AS (SELECT clip, max(step) AS tp FROM m GROUP BY clip),
  s AS (SELECT user_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS clip, max(value) >= 100 AS long_event, min(value) < 5 AS low_snr, bool_or(event_type = 'error') AS overlap FROM events GROUP BY ALL),
  j AS (SELECT s.*, coalesce(tp, 0) AS tp, coalesce(np - tp, 0) AS fp, coalesce(nr - tp, 0) AS fn FROM s LEFT JOIN n USING (clip) LEFT JOIN t USING (clip))"""
_F1 = "count(*) AS n_clips, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::DOUBLE / nullif(sum(tp + fp), 0) AS precision, sum(tp)::DOUBLE / nullif(sum(tp + fn), 0) AS recall, 2.0::DOUBLE * sum(tp) / nullif(sum(2 * tp + fp + fn), 0) AS f1"


def _sliced(spark, d):
    """(event counts by clip, slices by clip): a clip is a user's day, views are references and clicks predictions."""
    e = table(spark, d, "events").withColumn("clip", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    side = F.when(F.col("event_type") == "view", "reference").otherwise("predicted")
    rows = e.where("event_type IN ('view', 'click')").select("clip", side.alias("side"), (S.micros("ts") / 1e6).alias("onset"))
    flags = [F.when(F.max("value") >= 100, "long_event"), F.when(F.min("value") < 5, "low_snr"), F.when(F.bool_or(F.col("event_type") == "error"), "overlap")]
    return metrics.event_counts(rows, key=["clip"], collar=3600.0), e.groupBy("clip").agg(F.array_compact(F.array(*flags)).alias("slices"))


@query(f"{_GREEDY}, x AS (SELECT unnest(list_filter(['all', CASE WHEN long_event THEN 'long_event' END, CASE WHEN low_snr THEN 'low_snr' END, CASE WHEN overlap THEN 'overlap' END], lambda s: s IS NOT NULL)) AS slice, tp, fp, fn FROM j) SELECT slice, {_F1} FROM x GROUP BY slice")
def slice_f1(spark, d):
    return studies.slice_grid(*_sliced(spark, d), ["clip"])


@query(f"{_GREEDY} SELECT long_event, overlap, {_F1} FROM j GROUP BY CUBE (long_event, overlap)")
def slice_f1_cross(spark, d):
    return studies.cross_cuts(*_sliced(spark, d), ["clip"], "long_event", "overlap")
