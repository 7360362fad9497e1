"""Queries over sequences: folds and islands, their SQL by recursion from row to row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import evaluation as E
from .operators import sequence as Q
from .registry import MINUTE, TIMED, WORDS, query, table, timed, words


@query(f"""
WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM ({WORDS})),
r AS (
  SELECT conv_id, turn, n, 0 AS caption, start AS s, length(text) AS chars FROM w WHERE n = 1
  UNION ALL
  SELECT w.conv_id, w.turn, w.n, CASE WHEN c THEN caption + 1 ELSE caption END, CASE WHEN c THEN w.start ELSE s END, CASE WHEN c THEN length(w.text) ELSE chars + 1 + length(w.text) END
  FROM (SELECT r.*, w, w."end" - r.s > 8.0 OR r.chars + length(w.text) + 1 > 92 AS c FROM r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn AND w.n = r.n + 1)
)
SELECT conv_id, turn, caption, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY pos) AS text FROM r JOIN w USING (conv_id, turn, n) GROUP BY ALL
""")
def caption_packing(spark, sf_dir):
    return Q.fold(words(spark, sf_dir).select("conv_id", "turn", "pos", "text", "start", "end"), ["conv_id", "turn"], ["pos"], Q.Captions, "caption int, start double, end double, text string")


@query(f"""
WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM ({WORDS})),
r AS (
  SELECT conv_id, pos, n, 0 AS unit, start AS s, "end" AS e, text AS t FROM w WHERE n = 1
  UNION ALL
  SELECT conv_id, w.pos, w.n, CASE WHEN c THEN unit + 1 ELSE unit END, CASE WHEN c THEN w.start ELSE s END, w."end", w.text
  FROM (SELECT r.*, w, greatest(0.0::DOUBLE, w.start - r.e) >= 0.65 OR right(rtrim(r.t, '"''»”)]}}'), 1) IN ('.', '?', '!', '…') OR w."end" - r.s > 10.0 AS c FROM r JOIN w ON w.conv_id = r.conv_id AND w.n = r.n + 1)
)
SELECT conv_id, pos, unit FROM r
""")
def phrase_units(spark, sf_dir):
    return Q.fold(words(spark, sf_dir).select("conv_id", "pos", "text", "start", "end"), ["conv_id"], ["pos"], Q.PhraseUnits, "pos bigint, unit int")


@query(f"""
WITH w AS ({WORDS}),
f AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR speaker IS DISTINCT FROM lag(speaker) OVER o
        OR start - lag("end") OVER o > CASE WHEN right(rtrim(lag(text) OVER o, ' '), 1) IN ('.', '?', '!', '…') THEN 1.2 ELSE 3.0 END THEN 1 ELSE 0 END AS f FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
s AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS session FROM f)
SELECT conv_id, session::BIGINT AS session, arg_min(start, pos) AS start, arg_max("end", pos) AS "end", arg_min(speaker, pos) AS speaker, trim(string_agg(text, ' ' ORDER BY pos)) AS text, printf('U%05d', session::BIGINT + 1) AS utterance_id FROM s GROUP BY conv_id, session
""")
def utterances(spark, sf_dir):
    return Q.utterances(words(spark, sf_dir), ["conv_id"]).drop("flags")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn AS pos, length(coalesce(text, '')) + 160 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (
  SELECT conv_id, pos, n, 0 AS packet, cost AS size FROM c WHERE n = 1
  UNION ALL
  SELECT c.conv_id, c.pos, c.n, CASE WHEN r.size + c.cost > 2000 THEN packet + 1 ELSE packet END, CASE WHEN r.size + c.cost > 2000 THEN c.cost ELSE r.size + c.cost END FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1
)
SELECT DISTINCT a.conv_id, b.packet, a.pos, CASE WHEN a.packet = b.packet THEN 'core' ELSE 'context' END AS role FROM r AS a JOIN r AS b ON a.conv_id = b.conv_id AND abs(a.n - b.n) <= 1
""")
def packet_planning(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    return Q.packets(c, ["conv_id"], 2000, 1)


@query(f"""
WITH RECURSIVE t AS (SELECT user_id, start / 60000000 AS s, "end" / 60000000 AS e, row_number() OVER (PARTITION BY user_id ORDER BY start, "end") AS n FROM ({TIMED})),
r AS (
  SELECT user_id, n, 0 AS g, s, e FROM t WHERE n = 1
  UNION ALL
  SELECT user_id, t.n, CASE WHEN c THEN g + 1 ELSE g END, CASE WHEN c THEN t.s ELSE r_s END, CASE WHEN c THEN t.e ELSE greatest(r_e, t.e) END
  FROM (SELECT r.user_id, r.g, r.s AS r_s, r.e AS r_e, t, t.s - r.e > 0.45 OR t.e - r.s > 22.0 AS c FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
),
m AS (SELECT user_id, g, min(s) AS s, max(e) AS e FROM r GROUP BY user_id, g),
k AS (SELECT user_id, g, s AS x, e FROM m UNION ALL SELECT user_id, g, x + (22.0::DOUBLE - 0.45::DOUBLE), e FROM k WHERE e - x > 22.0)
SELECT user_id, x AS start, least(e, x + 22.0::DOUBLE) AS "end" FROM k WHERE e - x >= 0.20
""")
def speech_chunks(spark, sf_dir):
    t = timed(spark, sf_dir).select("user_id", (F.col("start") / MINUTE).alias("start"), (F.col("end") / MINUTE).alias("end"))
    return Q.fold(t, ["user_id"], ["start", "end"], lambda: Q.SpeechChunks(22.0, 0.45), "start double, end double")


@query("""
WITH RECURSIVE c AS (
  SELECT conv_id, conv_id * 1000 + turn AS claim_id, turn::DOUBLE * 40 AS s, turn::DOUBLE * 40 + 30 AS e, role, list_distinct(list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-zа-яё0-9]+'), lambda x: length(x) > 2)) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations
), r AS (
  SELECT conv_id, claim_id, n, 0 AS episode, e, [w] AS ws, [role] AS es FROM c WHERE n = 1
  UNION ALL
  SELECT conv_id, x.claim_id, x.n, CASE WHEN cut THEN episode + 1 ELSE episode END, x.e, CASE WHEN cut THEN [x.w] ELSE list_append(ws[-3:], x.w) END, CASE WHEN cut THEN [x.role] ELSE list_append(es[-3:], x.role) END
  FROM (SELECT r.*, c AS x, c.s - r.e > 150.0 OR
          least(1.0::DOUBLE, greatest(0.0::DOUBLE, c.s - r.e) / 300 + (1 - len(list_intersect(c.w, flatten(ws))) / greatest(1, len(list_distinct(list_concat(c.w, flatten(ws)))))::DOUBLE) * 0.25::DOUBLE
            + CASE WHEN list_contains(es, c.role) THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN c.role = 'user' THEN 0.2::DOUBLE ELSE 0 END) >= 0.72 AS cut
        FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1)
)
SELECT conv_id, claim_id, episode FROM r
""")
def episode_segmentation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), (F.col("turn") * 40.0).alias("start"), (F.col("turn") * 40.0 + 30).alias("end"), F.col("text").alias("statement"), F.array(F.col("role")).alias("entities"), F.when(F.col("role") == "user", "question").otherwise("state").alias("kind"), F.lit(False).alias("cue"), F.lit(0.0).alias("shift"))
    return Q.fold(rows, ["conv_id"], ["start", "claim_id"], Q.Episodes, "claim_id bigint, episode int")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn AS pos, turn::DOUBLE * 90 AS s, turn::DOUBLE * 90 + 60 AS e, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (
  SELECT conv_id, pos, n, 0 AS zone, s AS zs, e, role FROM c WHERE n = 1
  UNION ALL
  SELECT conv_id, x.pos, x.n, CASE WHEN cut THEN zone + 1 ELSE zone END, CASE WHEN cut THEN x.s ELSE zs END, x.e, x.role
  FROM (SELECT r.*, c AS x, r.e - r.zs >= 480 OR (c.e - r.zs >= 300 AND (c.s - r.e >= 0.8 OR c.role IS DISTINCT FROM r.role)) AS cut FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1)
)
SELECT conv_id, pos, zone FROM r
""")
def summary_zones(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.col("turn").alias("pos"), (F.col("turn") * 90.0).alias("start"), (F.col("turn") * 90.0 + 60).alias("end"), F.col("role").alias("speaker"))
    return Q.fold(rows, ["conv_id"], ["pos"], Q.Zones, "pos bigint, zone int")


@query("""
WITH RECURSIVE c AS (
  SELECT conv_id, turn AS item_id, list_distinct(list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-zа-яё0-9]+'), lambda x: length(x) > 2)) AS w,
    row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) DESC, turn) AS n FROM conversations
), r AS (
  SELECT conv_id, 0::BIGINT AS n, NULL::BIGINT AS item_id, 0 AS place, []::VARCHAR[][] AS taken, false AS took FROM c WHERE n = 1
  UNION ALL
  SELECT conv_id, x.n, x.item_id, CASE WHEN ok THEN place + 1 ELSE place END, CASE WHEN ok THEN list_append(taken, x.w) ELSE taken END, ok
  FROM (SELECT r.*, c AS x, c.item_id = 0 OR (r.place < 3 AND len(list_filter(r.taken, lambda t: len(list_intersect(c.w, t)) / greatest(1, least(len(c.w), len(t)))::DOUBLE >= 0.72)) = 0) AS ok
        FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1)
)
SELECT conv_id, item_id, place FROM r WHERE took
""")
def diverse_top(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.col("turn").alias("item_id"), F.col("text").alias("statement"), (F.col("turn") == 0).alias("mandatory"), F.length(F.coalesce("text", F.lit(""))).alias("worth"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("worth").desc(), "item_id")))
    return Q.fold(rows, ["conv_id"], ["k"], lambda: Q.Diverse(3), "item_id bigint, place int")


@query(f"""
WITH RECURSIVE t AS (SELECT user_id, event_id AS pos, event_type AS speaker, start / 60000000 AS s, "end" / 60000000 AS e, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS n FROM ({TIMED})),
r AS (
  SELECT user_id, pos, n, 0 AS unit, speaker, s, e FROM t WHERE n = 1
  UNION ALL
  SELECT user_id, x.pos, x.n, CASE WHEN j THEN unit ELSE unit + 1 END, x.speaker, CASE WHEN j THEN s ELSE x.s END, x.e
  FROM (SELECT r.*, t AS x, coalesce(t.speaker = r.speaker, false) AND greatest(0.0::DOUBLE, t.s - r.e) <= 600.0 AND t.e - r.s <= 1200.0 AS j FROM r JOIN t ON t.user_id = r.user_id AND t.n = r.n + 1)
)
SELECT user_id, pos, unit FROM r
""")
def identity_windows(spark, sf_dir):
    t = timed(spark, sf_dir).select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("speaker"), (F.col("start") / MINUTE).alias("start"), (F.col("end") / MINUTE).alias("end"))
    return Q.fold(t, ["user_id"], ["start", "pos"], lambda: Q.MergeUnits(600.0, 1200.0), "pos bigint, unit int")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, event_id % 2 AS side FROM events),
p AS (SELECT a.event_type AS l, b.event_type AS r, count(*)::DOUBLE AS score FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND a.side = 0 AND b.side = 1 GROUP BY ALL),
n AS (SELECT l, row_number() OVER (ORDER BY l) AS k FROM (SELECT DISTINCT l FROM p)),
m AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS rs, 0.0::DOUBLE AS total UNION ALL SELECT n.k, list_append(m.rs, p.r), m.total + p.score FROM m JOIN n ON n.k = m.k + 1 JOIN p ON p.l = n.l WHERE NOT list_contains(m.rs, p.r)),
b AS (SELECT rs FROM m WHERE k = (SELECT max(k) FROM m) ORDER BY total DESC, rs LIMIT 1)
SELECT 0 AS g, n.l AS "left", b.rs[n.k] AS "right", p.score FROM n, b JOIN p ON p.l = n.l AND p.r = b.rs[n.k]
""")
def label_assignment(spark, sf_dir):
    """The one-to-one mapping of event types between both halves of users, by shared users."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 2).alias("side")).distinct()
    a, b = e.where("side = 0"), e.where("side = 1")
    pairs = a.select("user_id", F.col("event_type").alias("left")).join(b.select("user_id", F.col("event_type").alias("right")), "user_id").groupBy("left", "right").agg(F.count("*").cast("double").alias("score"))
    return E.best_assignment(pairs.withColumn("g", F.lit(0)), ["g"])
