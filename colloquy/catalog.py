"""All queries of the reference operators over the driver's tables, with their SQL.

Times are whole microseconds and amounts whole cents, so that results are exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import aggregates as A
from .operators import evaluation as E
from .operators import intervals as I
from .operators import matching as M
from .operators import sequence as Q
from .operators import state as G
from .registry import DAY, HOUR, MINUTE, ORACLES, QUERIES, TIMED, micros, query, table, timed  # noqa: F401

UNION_CTE = f"""
  t AS ({TIMED}),
  m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t WHERE "end" > start),
  i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m),
  u AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY user_id, k)
"""


@query(f'WITH {UNION_CTE} SELECT user_id, sum("end" - start)::BIGINT AS measure, count(*) AS n_intervals FROM u GROUP BY user_id')
def interval_union(spark, sf_dir):
    return I.measure(timed(spark, sf_dir), ["user_id"])


@query(f"""
WITH t AS ({TIMED}),
p AS (SELECT a.event_id, a.user_id, b.event_id AS other_id, least(a."end", b."end") - greatest(a.start, b.start) AS amount
      FROM t AS a JOIN t AS b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.start < b."end" AND b.start < a."end")
SELECT event_id, user_id, other_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY amount DESC, other_id) AS k FROM p) WHERE k = 1
""")
def interval_overlap_join(spark, sf_dir):
    t = timed(spark, sf_dir)
    views, clicks = t.where("event_type = 'view'"), t.where("event_type = 'click'").select("user_id", "event_id", "start", "end")
    best = I.best_overlap(views, clicks, ["user_id"], "event_id", "event_id", 2 * HOUR, least_share=0.0)
    return best.select("event_id", "user_id", F.col("r_event_id").alias("other_id"), "amount")


@query(f"""
WITH t AS ({TIMED}), p AS (
  SELECT a.user_id, sum(least(a."end", b."end") - greatest(a.start, b.start))::BIGINT AS measure
  FROM (SELECT * FROM t WHERE event_type = 'view') AS a JOIN (SELECT * FROM t WHERE event_type = 'error') AS b
    ON a.user_id = b.user_id AND a.start < b."end" AND b.start < a."end" GROUP BY a.user_id)
SELECT t1.user_id, t1.event_id, t2.event_type AS label, sum(least(t1."end", t2."end") - greatest(t1.start, t2.start))::BIGINT AS amount
FROM t AS t1 JOIN t AS t2 ON t1.user_id = t2.user_id AND t1.event_type = 'purchase' AND t1.start < t2."end" AND t2.start < t1."end"
GROUP BY ALL
""")
def label_support(spark, sf_dir):
    t = timed(spark, sf_dir)
    got = I.support(t.where("event_type = 'purchase'").select("user_id", "event_id", "start", "end"), t.select("user_id", "event_type", "start", "end"), ["user_id"], "event_id", "event_type", 2 * HOUR)
    return got.select("user_id", "event_id", F.col("event_type").alias("label"), "amount")


@query(f"""
WITH t AS ({TIMED}),
pt AS (SELECT DISTINCT user_id, unnest([start, "end"]) AS start FROM t WHERE "end" > start),
sg AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS "end" FROM pt)
SELECT sg.user_id, sg.start, sg."end", array_to_string(list_sort(list_distinct(list(t.event_type))), ',') AS labels
FROM sg JOIN t ON sg.user_id = t.user_id AND sg.start < t."end" AND t.start < sg."end" AND t."end" > t.start
GROUP BY ALL
""")
def atomic_segments(spark, sf_dir):
    got = I.atomic_segments(timed(spark, sf_dir).select("user_id", "start", "end", "event_type"), ["user_id"], "event_type", 2 * HOUR)
    return got.withColumn("labels", F.array_join("labels", ","))


@query(f"""
WITH t AS ({TIMED}),
d AS (SELECT DISTINCT a.event_id FROM t AS a JOIN t AS b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.start < b."end" AND b.start < a."end"
      WHERE least(a."end", b."end") - greatest(a.start, b.start) > 60000000)
SELECT user_id, event_type, event_id, start, "end", rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY least("end" - start, 3600000000) DESC, start DESC) AS INTEGER) AS rank
  FROM t WHERE event_id NOT IN (SELECT event_id FROM d)) WHERE rank <= 3
""")
def clean_samples(spark, sf_dir):
    t = timed(spark, sf_dir).select("user_id", "event_type", "event_id", "start", "end")
    return I.clean_samples(t, ["user_id"], "event_type", 2 * HOUR, 3, MINUTE, HOUR).select("user_id", "event_type", "event_id", "start", "end", "rank")


@query(f"""
WITH t AS ({TIMED}), a AS (SELECT * FROM t WHERE event_type IN ('view', 'click')), h AS (SELECT * FROM t WHERE event_type IN ('view', 'error')),
l AS (SELECT user_id, start, "end", 'r:' || event_type AS l FROM a WHERE "end" > start UNION ALL SELECT user_id, start, "end", 'h:' || event_type FROM h WHERE "end" > start),
pt AS (SELECT DISTINCT user_id, unnest([start, "end"]) AS start FROM l),
sg AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS "end" FROM pt),
s AS (SELECT sg.user_id, sg.start, sg."end", sg."end" - sg.start AS d, list_distinct(list(l.l)) AS ls
      FROM sg JOIN l ON sg.user_id = l.user_id AND sg.start < l."end" AND l.start < sg."end" GROUP BY ALL),
n AS (SELECT user_id, d, len(list_filter(ls, lambda x: x LIKE 'r:%')) AS r, len(list_filter(ls, lambda x: x LIKE 'h:%')) AS h,
      (list_contains(ls, 'r:view') AND list_contains(ls, 'h:view'))::INTEGER AS k FROM s),
z AS (SELECT user_id, sum(r * d)::BIGINT AS reference_time, sum(greatest(0, r - h) * d)::BIGINT AS miss, sum(greatest(0, h - r) * d)::BIGINT AS false_alarm, sum((least(r, h) - k) * d)::BIGINT AS confusion FROM n GROUP BY user_id)
SELECT *, (miss + false_alarm + confusion) / greatest(1e-9, reference_time::DOUBLE) AS der FROM z
""")
def diarization_error(spark, sf_dir):
    t = timed(spark, sf_dir).select("user_id", "start", "end", "event_type")
    return I.error_rate(t.where("event_type in ('view', 'click')"), t.where("event_type in ('view', 'error')"), ["user_id"], "event_type", 2 * HOUR)


@query(f"""
WITH t AS (SELECT *, start AS "last" FROM ({TIMED})),
f AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR event_type <> lag(event_type) OVER w OR start - lag(start) OVER w > 21600000000 THEN 1 ELSE 0 END AS f
      FROM t WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS UNBOUNDED PRECEDING) - 1 AS session FROM f)
SELECT user_id, session::BIGINT AS session, min(start) AS start, max(start) AS last_start, count(*) AS n_events, any_value(event_type) AS event_type FROM s GROUP BY user_id, session
""")
def sessionize(spark, sf_dir):
    t = timed(spark, sf_dir)
    s = Q.sessions(t, ["user_id"], ["start", "event_id"], "event_type", 6 * HOUR, start="start", end="start")
    return s.groupBy("user_id", "session").agg(F.min("start").alias("start"), F.max("start").alias("last_start"), F.count("*").alias("n_events"), F.first("event_type").alias("event_type"))


@query(f"""
WITH t AS ({TIMED}),
f AS (SELECT *, CASE WHEN lag(event_id) OVER w IS NULL OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS f FROM t WINDOW w AS (PARTITION BY user_id ORDER BY start, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS UNBOUNDED PRECEDING) - 1 AS island FROM f)
SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, island
""")
def run_islands(spark, sf_dir):
    r = Q.runs(timed(spark, sf_dir), ["user_id"], ["start", "event_id"], "event_type")
    return r.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"""
WITH t AS ({TIMED}),
m AS (SELECT *, max("end") OVER (PARTITION BY user_id, event_type ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start - b > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, event_type, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY user_id, event_type, k
""")
def merge_near_intervals(spark, sf_dir):
    return Q.merge_near(timed(spark, sf_dir).select("user_id", "event_type", "start", "end"), ["user_id", "event_type"], HOUR)


@query(f"""
WITH t AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS label FROM ({TIMED})),
w AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
        first_value(label IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a,
        last_value(CASE WHEN label IS NOT NULL THEN "end" END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t0,
        first_value(CASE WHEN label IS NOT NULL THEN start END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t1 FROM t)
SELECT event_id, user_id, CASE WHEN label IS NULL AND a = b AND t1 - t0 <= 86400000000 THEN b ELSE label END AS label, coalesce(label IS NULL AND a = b AND t1 - t0 <= 86400000000, false) AS bridged FROM w
""")
def bridge_gaps(spark, sf_dir):
    t = timed(spark, sf_dir).withColumn("label", F.when(F.col("event_type").isin("view", "click"), F.col("event_type")))
    return Q.bridge_gaps(t, ["user_id"], ["start", "event_id"], "label", DAY).select("event_id", "user_id", "label", "bridged")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def file_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id", "digest", "n")


@query("""
WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\\p{L}\\p{M}\\p{N}_%]+', ' ', 'g')) AS t, conv_id * 1000 + turn AS id FROM conversations)
SELECT arg_min(conv_id, id) AS conv_id, arg_min(turn, id) AS turn, role, count(*) AS n_merged, array_to_string(list_sort(list_distinct(list(id))), ',') AS lineage FROM c GROUP BY t, role
""")
def fact_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    d = A.deduplicate(c, "text", ["role"], ["id"], "id")
    return d.select("conv_id", "turn", "role", "n_merged", F.array_join(F.col("lineage").cast("array<string>"), ",").alias("lineage"))


@query("""
SELECT b.item_id, d.doc_id, strpos(d.text, b.text) - 1 AS at FROM benchmark AS b JOIN documents AS d ON strpos(d.text, b.text) > 0
WHERE (length(d.text) - length(replace(d.text, b.text, ''))) = length(b.text)
""")
def quote_grounding(spark, sf_dir):
    """Exact quotes that occur once.

    Words inside a quote stand in the document as whole words, so documents are probed by the
    quote's second to fourth word; quotes of fewer than five words are looked for directly.
    """
    docs, items = table(spark, sf_dir, "documents").where("text is not null"), table(spark, sf_dir, "benchmark").where("text <> ''")
    triple = lambda w, i: F.xxhash64(*[F.element_at(w, i + k) for k in range(3)])
    quotes = items.select("item_id", F.col("text").alias("quote"), F.split("text", " ").alias("w"))
    keys = quotes.where(F.size("w") >= 5).select("item_id", "quote", triple(F.col("w"), F.lit(2)).alias("h"))
    split = docs.select("doc_id", F.split("text", " ").alias("w"))
    runs = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: triple(F.col("w"), i)))
    spread = split.select("doc_id", runs.alias("hs")).select("doc_id", F.explode_outer("hs").alias("h"))
    hits = spread.join(M.bounded(keys), "h").select("doc_id", "item_id", "quote").distinct()
    short = M.bounded(quotes.where(F.size("w") < 5).select("item_id", "quote"))
    pairs = hits.join(docs.select("doc_id", "text"), "doc_id").unionByName(docs.select("doc_id", "text").join(short, F.col("text").contains(F.col("quote"))))
    return pairs.withColumn("at", S.grounded_offset("text", "quote").cast("bigint")).where("at is not null").select("item_id", "doc_id", "at")


@query("""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-zа-яё0-9]+'), lambda x: length(x) > 2)) AS w FROM conversations)
SELECT a.conv_id, a.turn, b.turn AS p_turn, (a.turn - b.turn)::INTEGER AS distance,
       len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w))))::DOUBLE AS similarity
FROM t AS a JOIN t AS b ON a.conv_id = b.conv_id AND a.turn - b.turn BETWEEN 1 AND 8
""")
def lookback_similarity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("w", S.tokens("text")).select("conv_id", "turn", "w")
    p = M.look_back(c, ["conv_id"], ["turn"], 8, ["turn", "w"])
    return p.select("conv_id", "turn", "p_turn", "distance", S.jaccard(F.col("w"), F.col("p_w")).alias("similarity"))


@query(f"""
WITH t AS ({TIMED})
SELECT event_id, n_event_id, rank FROM (
  SELECT a.event_id, b.event_id AS n_event_id, CAST(row_number() OVER (PARTITION BY a.event_id ORDER BY b.value DESC, b.start, b.event_id) AS INTEGER) AS rank
  FROM t AS a JOIN t AS b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.start > a.start AND b.start - a.start <= 259200000000) WHERE rank <= 8
""")
def next_window_topk(spark, sf_dir):
    t = timed(spark, sf_dir)
    n = M.look_ahead(t.where("event_type = 'purchase'").select("event_id", "user_id", "start"), t, ["user_id"], "start", 3 * DAY, ["event_id", "value"])
    return M.top_per(n, ["event_id"], [F.col("n_value").desc(), F.col("n_time"), F.col("n_event_id")], 8).select("event_id", "n_event_id", "rank")


@query(f"""
WITH t AS ({TIMED})
SELECT event_id, anchor, distance FROM (
  SELECT a.event_id, b.event_id AS anchor, abs(a.start - b.start) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.start - b.start), b.start, b.event_id) AS k
  FROM t AS a JOIN t AS b ON a.user_id = b.user_id AND a.event_type <> 'purchase' AND b.event_type = 'purchase') WHERE k = 1
""")
def nearest_anchor(spark, sf_dir):
    t = timed(spark, sf_dir)
    got = M.nearest_anchor(t.where("event_type <> 'purchase'").select("event_id", "user_id", "start"), t.where("event_type = 'purchase'").select("user_id", "start", F.col("event_id").alias("anchor_id")), ["user_id"], "start", "anchor_id")
    return got.where("anchor is not null").select("event_id", "anchor", "distance")


@query("""
WITH p AS (SELECT vec_id AS profile_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 10),
s AS (SELECT v.vec_id, profile_id, list_dot_product(v.embedding::DOUBLE[], e) AS score FROM embeddings AS v, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, profile_id) AS k, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, profile_id) AS two FROM s)
SELECT vec_id, profile_id, round(score, 9) AS score, score >= 0.3 AND score - coalesce(two, -1) >= 0.02 AS accepted FROM r WHERE k = 1
""")
def voice_match(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    profiles = v.where("vec_id < 10").select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("prototype"), F.array(F.col("embedding")).alias("references"))
    return M.match_profiles(v, profiles, "vec_id", "embedding", 0.3, 0.02).select("vec_id", "profile_id", F.round("score", 9).alias("score"), "accepted")


@query("""
WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)
SELECT label, (i - 1)::INTEGER AS i, round(m / n, 9) AS x FROM m JOIN n USING (label)
""")
def centroid(spark, sf_dir):
    m = M.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("mean").alias("i", "x")).withColumn("x", F.round("x", 9))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS t, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus FROM orders)
SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'P' THEN cents // 2 ELSE cents END) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM o
""")
def rolling_spend(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    amount = F.coalesce(F.when(F.col("o_orderstatus") == "P", F.floor(F.col("cents") / 2)), F.col("cents"))
    return A.rolling_sum(o, ["o_custkey"], micros("o_orderdate"), amount, 7 * DAY).select("o_orderkey", "rolling")


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, value AS percentile FROM r WHERE k = floor((n - 1) * 0.95)
""")
def floor_percentile(spark, sf_dir):
    return A.floor_percentile(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


LABELLED = "SELECT doc_id, quality, toxic, ((doc_id * 37) % 101) / 100.0::DOUBLE AS c FROM labels"


@query(f"""
SELECT least(9, floor(c * 10))::INTEGER AS bin, count(*) AS n, round(avg(c), 9) AS mean_confidence, round(avg(quality), 9) AS accuracy FROM ({LABELLED}) GROUP BY 1
""")
def calibration_bins(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn("c", ((F.col("doc_id") * 37) % 101) / F.lit(100.0))
    return E.calibration_bins(lab, "c", "quality").withColumn("mean_confidence", F.round("mean_confidence", 9)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""
WITH s AS ({LABELLED}), b AS (SELECT least(9, floor(c * 10)) AS b, count(*) AS n, avg(c) AS mc, avg(quality) AS acc FROM s GROUP BY 1)
SELECT round((SELECT sum(n * abs(mc - acc)) / sum(n) FROM b), 9) AS ece, round((SELECT avg((c - quality) * (c - quality)) FROM s), 9) AS brier
""")
def calibration(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn("c", ((F.col("doc_id") * 37) % 101) / F.lit(100.0))
    return E.calibration(lab, "c", "quality").select(F.round("ece", 9).alias("ece"), F.round("brier", 9).alias("brier"))


@query("""
WITH n AS (SELECT count_if(quality = 1 AND toxic = 1)::BIGINT AS tp, count_if(quality <> 1 AND toxic = 1)::BIGINT AS fp, count_if(quality = 1 AND toxic <> 1)::BIGINT AS fn FROM labels),
m AS (SELECT *, tp / greatest(1, tp + fp)::DOUBLE AS precision, tp / greatest(1, tp + fn)::DOUBLE AS recall FROM n)
SELECT *, 2 * precision * recall / greatest(1e-12, precision + recall) AS f1 FROM m
""")
def set_prf(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return E.set_metrics(lab.where("quality = 1"), lab.where("toxic = 1"), "doc_id")


@query("""
WITH o AS (SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderkey, epoch_us(o_orderdate) AS t FROM orders),
h AS (SELECT quantile_disc(t, 0.5) AS h FROM o),
p AS (SELECT o_custkey, arg_max(o_orderstatus, (t, o_orderkey)) AS s FROM o, h WHERE t < h GROUP BY 1),
c AS (SELECT o_custkey, arg_max(o_orderstatus, (t, o_orderkey)) AS s FROM o, h WHERE t >= h GROUP BY 1)
SELECT coalesce(p.o_custkey, c.o_custkey) AS o_custkey,
  CASE WHEN p.s IS NULL THEN 'NEW' WHEN c.s IS NULL THEN CASE WHEN coalesce(p.o_custkey, c.o_custkey) % 2 = 0 THEN 'RESOLVED' ELSE 'CHANGED' END
       WHEN p.s <> c.s THEN 'CHANGED' WHEN p.o_custkey % 2 = 0 THEN 'STILL_OPEN' ELSE 'CONFIRMED' END AS status, p.s AS previous_state, c.s AS state
FROM p FULL JOIN c ON p.o_custkey = c.o_custkey
""")
def state_delta(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("t", micros("o_orderdate"))
    h = o.agg(F.percentile_disc(0.5, "t") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by t)")).first()[0]
    last = lambda df: G.latest_state(df, ["o_custkey"], ["t", "o_orderkey"], ["o_orderstatus"])
    return G.delta(last(o.where(F.col("t") < h)), last(o.where(F.col("t") >= h)), ["o_custkey"], "o_orderstatus", F.col("o_custkey") % 2 == 0)


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1
""")
def latest_state(spark, sf_dir):
    return G.latest_state(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_discount, l_tax) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 3
""")
def topk_per_group(spark, sf_dir):
    order = [F.col("l_extendedprice").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_discount", "l_tax"))]
    return A.top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("""
WITH m AS (SELECT * FROM part WHERE p_size = 50), o AS (SELECT * FROM part WHERE p_size <> 50 AND p_retailprice >= 905)
SELECT p_partkey, p_size FROM m UNION ALL
SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM o) WHERE k <= greatest(0, 100 - (SELECT count(*) FROM m))
""")
def mandatory_budget(spark, sf_dir):
    return A.mandatory_budget(table(spark, sf_dir, "part"), F.col("p_size") == 50, "p_retailprice", "p_partkey", 100, 905.0).select("p_partkey", "p_size")


@query("""
WITH e AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT'), g AS (SELECT l_orderkey, count(*) AS n, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' WHEN ok THEN 'ok' ELSE 'invalid' END AS outcome
FROM e FULL JOIN g ON o_orderkey = l_orderkey
""")
def batch_outcomes(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'")
    got = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return A.batch_outcomes(expected, got, "o_orderkey", F.col("l_returnflag") != "R")


@query("""
SELECT o_orderpriority, count(*) AS expected, count(k) AS covered, count(k) / count(*)::DOUBLE AS coverage
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.05) ON o_orderkey = k GROUP BY 1
""")
def coverage(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.coverage(table(spark, sf_dir, "orders"), got, "o_orderkey", ["o_orderpriority"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_rows(spark, sf_dir):
    return A.missing(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


ASCII_RISKS = {"number": "[0-9]", "secret": "(?i)password|token", "link": "https?://", "shout": "[A-Z]{5}"}
ASCII_WEIGHTS = {"number": 2, "secret": 5, "link": 3, "shout": 1}


@query("""
WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_matches(t, '[0-9]')::INTEGER AS n, regexp_matches(t, '(?i)password|token')::INTEGER AS s, regexp_matches(t, 'https?://')::INTEGER AS l, regexp_matches(t, '[A-Z]{5}')::INTEGER AS h FROM r)
SELECT doc_id, concat_ws(',', CASE WHEN l = 1 THEN 'link' END, CASE WHEN n = 1 THEN 'number' END, CASE WHEN s = 1 THEN 'secret' END, CASE WHEN h = 1 THEN 'shout' END) AS risks,
  CASE WHEN 2 * n + 5 * s + 3 * l + h >= 8 THEN 'CRITICAL' WHEN 2 * n + 5 * s + 3 * l + h >= 5 THEN 'HIGH' WHEN 2 * n + 5 * s + 3 * l + h >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM f
""")
def risk_level(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.semantic_risks("text", patterns=ASCII_RISKS).alias("r"))
    return d.select("doc_id", F.array_join("r", ",").alias("risks"), S.risk_level("r", weights=ASCII_WEIGHTS).alias("level"))


@query("""
WITH m AS (SELECT event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms % 3600000) // 60000, (ms % 60000) // 1000, ms % 1000) AS at FROM m
""")
def time_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.timestamp("value").alias("at"))


@query("SELECT doc_id, 'D' || substr(sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'), 1, 16) AS id FROM documents")
def stable_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.stable_id("D", S.canonical_json({"source": "source", "lang": "lang"})).alias("id"))


@query("SELECT doc_id, ((octet_length(encode(coalesce(text, ''))) * 6 + 4) // 5)::BIGINT AS input_upper FROM documents")
def input_upper(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.input_upper("text").alias("input_upper"))


@query("""
WITH a AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, printf('W%08d', n) AS word_id FROM a
""")
def attach_word_ids(spark, sf_dir):
    return Q.word_ids(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "word_id")


@query("""
SELECT doc_id, r AS range_start, least(r + 1000, n_chars) AS range_end FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 1000)) AS r FROM documents WHERE n_chars > 0)
""")
def tumbling_ranges(spark, sf_dir):
    return Q.tumbling_ranges(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 1000).select("doc_id", "range_start", "range_end")


@query("""
SELECT * FROM (
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F')
SELECT *, 'removed' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
""")
def set_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return G.set_difference(li.where("l_returnflag = 'A'").select(*cols), li.where("l_linestatus = 'F'").select(*cols))


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1
""")
def modal_value(spark, sf_dir):
    return A.modal(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""
WITH e AS (SELECT min(event_id) AS a, user_id FROM events GROUP BY user_id, (event_id // 50))
SELECT user_id, count(*) AS n FROM e GROUP BY user_id
""")
def grouped_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("b", F.floor(F.col("event_id") / 50))
    return e.select("user_id", "b").distinct().groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
SELECT event_type AS name, count(*) AS n, min(ts) AS first, max(ts) AS last, count_if(value > 100)::BIGINT AS errors, max(value) AS max_ms FROM events GROUP BY 1
""")
def log_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("c").alias("category"), F.col("event_type").alias("name"), F.lit("ok").alias("outcome"), F.when(F.col("value") > 100, "error").otherwise("info").alias("severity"), F.col("ts").alias("timestamp"), F.col("value").alias("duration_ms"))
    return A.log_rollup(e).select("name", "n", "first", "last", "errors", "max_ms")


@query("""
WITH s AS (SELECT DISTINCT o_orderstatus FROM orders), d AS (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus)
SELECT d.o_orderstatus, count(o_orderkey) AS n FROM d LEFT JOIN orders USING (o_orderstatus) GROUP BY 1
""")
def status_counts(spark, sf_dir):
    return A.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("""
WITH a AS (SELECT p_partkey, p_brand, p_type, p_retailprice FROM part)
SELECT p_brand, arg_max(p_partkey, (p_retailprice, p_partkey)) AS p_partkey, max(p_retailprice) AS price FROM a GROUP BY 1
""")
def pick_latest(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("p_partkey"), F.max("p_retailprice").alias("price"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
p AS (SELECT DISTINCT a.s AS x, b.s AS y FROM e AS a JOIN e AS b ON a.o = b.o),
r AS (SELECT x AS node, x AS root FROM p UNION SELECT p.y, r.root FROM r JOIN p ON r.node = p.x AND r.root < p.y)
SELECT node, min(root) AS root FROM r GROUP BY node
""")
def linked_components(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    low = e.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"))
    return G.components(e.join(low, "l_orderkey").select("a", F.col("l_suppkey").alias("b")))


from . import catalog_files, catalog_graph, catalog_meeting, catalog_records, catalog_runs, catalog_semantics, catalog_sequence, catalog_text  # noqa: E402, F401
