"""Queries that go through files: what is written in the folder all executors share is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .catalog_records import REC, records
from .operators import sequence as Q
from .registry import WORDS, query, table, words
from .sources import formats as Z


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names, or beside the tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT 's' AS recording, start, \"end\", speaker, count(*) AS n FROM ({REC}) GROUP BY ALL")
def rttm_round_trip(spark, sf_dir):
    """S10 S11."""
    path = folder(spark, "rttm")
    Z.rttm_lines(records(spark, sf_dir), "s").write.text(path)
    return Z.read_rttm(spark, path).groupBy("recording", "start", "end", "speaker").agg(F.count("*").alias("n"))


@query(f"SELECT (turn * 40)::INTEGER AS start, speaker, string_split(t, chr(10))[1] AS text, count(*) AS n FROM ({REC}) GROUP BY ALL")
def text_transcripts(spark, sf_dir):
    """Lines of all meetings, with some that are none among them."""
    path = folder(spark, "transcript")
    at = F.format_string("[%02d:%02d:%02d] ", F.floor(F.col("start") / 3600), F.floor((F.col("start") % 3600) / 60), (F.col("start") % 60).cast("bigint"))
    r = records(spark, sf_dir)
    r.select(F.concat(at, "speaker", F.lit(": "), "t").alias("value")).unionByName(r.where("rid % 9 = 0").select(F.lit("no line").alias("value"))).write.text(path)
    return Z.read_text_transcript(spark, path).groupBy("start", "speaker", "text").agg(F.count("*").alias("n"))


@query(f"""
WITH c AS (SELECT conv_id, turn, min(start) AS s, max("end") AS e, string_agg(text, ' ' ORDER BY pos) AS text FROM ({WORDS}) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CAST(round_even(s * 1000, 0) AS BIGINT) AS a, CAST(round_even(e * 1000, 0) AS BIGINT) AS b FROM c)
SELECT conv_id, k::INTEGER AS number, k || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a % 3600000 // 60000, a % 60000 // 1000, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b % 3600000 // 60000, b % 60000 // 1000, b % 1000) || chr(10) || text || chr(10) AS value FROM n
""")
def subtitles(spark, sf_dir):
    """Each turn as a caption."""
    w = words(spark, sf_dir)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    c = w.groupBy("conv_id", F.col("turn").alias("caption")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(rows, " ").alias("text"))
    return Z.srt_blocks(c, ("conv_id",))


@query("SELECT event_type AS name, CASE WHEN event_id % 3 = 0 THEN 'trace' ELSE 'main' END AS part, count(*) AS n, round(sum(value), 6) AS ms FROM events GROUP BY ALL")
def event_logs(spark, sf_dir):
    """Events as a log in two parts, with broken lines that are set apart."""
    path = folder(spark, "log")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 3 == 0, "trace").otherwise("job").alias("category"), F.col("event_type").alias("name"), F.col("value").alias("duration_ms"))
    Z.write_events(e, path)
    e.where("duration_ms < 1").select(F.lit("{broken").alias("value")).write.mode("append").text(f"{path}/main")
    out = None
    for part in ("main", "trace"):
        good = Z.read_events(spark, f"{path}/{part}")[0].withColumn("part", F.lit(part))
        out = good if out is None else out.unionByName(good)
    return out.groupBy("name", "part").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 6).alias("ms"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def published_generations(spark, sf_dir):
    """Two generations of a table; readers get the newest."""
    path = folder(spark, "published")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    Z.publish(d.where("doc_id % 2 = 0"), path, "g1")
    Z.publish(d.where("doc_id % 2 = 1"), path, "g2")
    return Z.current(spark, path).select("doc_id", "source")


@query(f"""
WITH r AS ({REC}), u AS (SELECT meeting_id, row_number() OVER (PARTITION BY meeting_id ORDER BY turn) AS k, turn, speaker, t FROM r)
SELECT meeting_id::VARCHAR AS meeting_id, printf('U%05d', k) AS utterance_id, (turn * 40000)::BIGINT AS start_ms, CASE speaker WHEN 'user' THEN 'Ann' ELSE speaker END AS speaker, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS text FROM u WHERE meeting_id % 7 <> 0
""")
def transcript_files(spark, sf_dir):
    """One JSON file for each meeting; those of every seventh have an end before its start and are rejected."""
    path = folder(spark, "transcripts")
    r = records(spark, sf_dir)
    end = F.when(F.col("meeting_id") % 7 == 0, F.col("start") - 1).otherwise(F.col("end"))
    u = F.struct("turn", "start", end.alias("end"), "speaker", F.col("t").alias("text"))
    docs = r.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(u)), lambda x: x.dropFields("turn")).alias("utterances"))
    doc = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("meeting_id").cast("string").alias("source"), F.create_map(F.lit("user"), F.lit("Ann")).alias("speakers"), "utterances"))
    docs.select("meeting_id", doc.alias("value")).repartition("meeting_id").write.partitionBy("meeting_id").text(path)
    good, _ = Z.read_transcripts(spark, f"{path}/*")
    return good.select(F.col("source").alias("meeting_id"), "utterance_id", "start_ms", "speaker", "text")


@query(f"""
WITH RECURSIVE r AS (SELECT *, 'E' || (rid % 9) AS e, list_distinct(list_filter(regexp_extract_all(lower(t), '[a-zа-яё0-9]+'), lambda x: length(x) > 2)) AS w, row_number() OVER (PARTITION BY meeting_id ORDER BY turn) AS n FROM ({REC})),
s AS (SELECT meeting_id, 0::BIGINT AS n, NULL::VARCHAR AS record_id, 0::BIGINT AS thread, []::VARCHAR[][] AS ws, []::VARCHAR[][] AS es FROM r WHERE n = 1
  UNION ALL SELECT meeting_id, x.n, x.record_id, CASE WHEN k IS NULL THEN len(ws) ELSE k - 1 END, CASE WHEN k IS NULL THEN list_append(ws, x.w) ELSE list_concat(list_append(ws[1:k - 1], list_distinct(list_concat(ws[k], x.w))), ws[k + 1:]) END, CASE WHEN k IS NULL THEN list_append(es, [x.e]) ELSE list_concat(list_append(es[1:k - 1], list_append(es[k], x.e)), es[k + 1:]) END
  FROM (SELECT s.*, r AS x, nullif(list_position(list_transform(range(1, len(s.ws) + 1), lambda i: len(list_intersect(s.ws[i], r.w)) / greatest(1, len(list_distinct(list_concat(s.ws[i], r.w))))::DOUBLE >= 0.18 OR list_contains(s.es[i], r.e)), true), 0) AS k FROM s JOIN r ON r.meeting_id = s.meeting_id AND r.n = s.n + 1))
SELECT meeting_id, record_id AS episode_id, thread::INTEGER AS thread FROM s WHERE n > 0
""")
def episode_threads(spark, sf_dir):
    """Each record is an episode with one entity; words are those of the lower-cased text, a sharp s parts two of them."""
    words = F.filter(F.regexp_extract_all(F.lower("t"), F.lit("([a-zа-яё0-9]+)"), 1), lambda x: F.length(x) > 2)
    r = records(spark, sf_dir).select("meeting_id", "turn", F.col("record_id").alias("episode_id"), words.alias("words"), F.array(F.concat(F.lit("E"), (F.col("rid") % 9).cast("string"))).alias("entities"))
    return Q.fold(r, ["meeting_id"], ["turn"], Q.Threads, "episode_id string, thread int")
