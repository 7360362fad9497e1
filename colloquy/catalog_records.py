"""Queries of facts, claims, reviews, tasks and state: every turn of the conversations is a record of a kind, linked to its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_text import SAID, SQUEEZED, TOKENS, said
from .operators import aggregates as A
from .operators import dialogue as D
from .operators import evaluation as E
from .operators import facts as X
from .operators import intervals as I
from .operators import matching as M
from .operators import sequence as Q
from .operators import state as G
from .registry import DAY, HOUR, TIMED, WORDS, query, table, timed, words
from .sources import formats as Z

KINDS = ("decision", "action", "question", "hypothesis", "proposal", "blocker", "observation")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, rid, record_id, turn, speaker, kind, start, end, t, o: one row for each turn."""
    rid = F.col("conv_id") * 1000 + F.col("turn")
    kind = F.get(F.array(*map(F.lit, KINDS)), F.pmod(rid, F.lit(7)).cast("int"))
    return said(spark, sf_dir).select(
        F.col("conv_id").alias("meeting_id"), rid.alias("rid"), ident("R", rid).alias("record_id"), "turn", F.col("role").alias("speaker"), kind.alias("kind"),
        (F.col("turn") * 40.0).alias("start"), (F.col("turn") * 40.0 + 30).alias("end"), "t", "o",
    )


def ident(letter: str, n: F.Column) -> F.Column:
    return F.concat(F.lit(letter), n.cast("string"))


REC = f"""SELECT conv_id AS meeting_id, conv_id * 1000 + turn AS rid, 'R' || (conv_id * 1000 + turn) AS record_id, turn, role AS speaker,
  ([{", ".join(f"'{k}'" for k in KINDS)}])[(conv_id * 1000 + turn) % 7 + 1] AS kind, turn::DOUBLE * 40 AS start, turn::DOUBLE * 40 + 30 AS "end", t, o FROM ({SAID})"""


def empty() -> F.Column:
    return F.array().cast("array<string>")



# ---------------------------------------------------------------- facts


@query(f"""
WITH r AS ({REC}), e AS (
  SELECT a.meeting_id, a.record_id AS fact_id, b.record_id AS e, b.start, b."end", b.t FROM r AS a JOIN r AS b ON a.meeting_id = b.meeting_id AND b.turn BETWEEN a.turn AND a.turn + 2 AND b.turn // 4 = a.turn // 4
), g AS (SELECT meeting_id, fact_id, string_agg(e, ',' ORDER BY e) AS evidence, min(start) AS start, max("end") AS "end", string_agg(t, ' ' ORDER BY start, e) AS evidence_text FROM e GROUP BY ALL)
SELECT g.fact_id, CASE WHEN r.kind IN ('decision', 'action', 'question') THEN r.kind ELSE 'observation' END AS type, evidence, g.start, g."end", evidence_text FROM g JOIN r ON g.fact_id = r.record_id WHERE r.rid % 11 <> 0
""")
def fact_admission(spark, sf_dir):
    """Facts cite three turns, of which those of their zone of four count."""
    r = records(spark, sf_dir)
    zone = F.concat_ws("/", "meeting_id", F.floor(F.col("turn") / 4))
    cited = F.array(*[ident("R", F.col("rid") + k) for k in (0, 1, 2, 1)])
    facts = r.select(zone.alias("zone_id"), F.col("record_id").alias("fact_id"), F.col("kind").alias("type"), F.when(F.col("rid") % 11 == 0, " ").otherwise(F.col("t")).alias("statement"), cited.alias("evidence_ids"))
    evidence = r.select(F.col("record_id").alias("evidence_id"), "start", "end", F.col("t").alias("text"))
    zones = r.select(zone.alias("zone_id"), F.col("record_id").alias("evidence_id"))
    out = X.admit(facts, evidence, zones, ["decision", "action", "question"])
    return out.select("fact_id", "type", F.array_join("evidence_ids", ",").alias("evidence"), "start", "end", "evidence_text")


@query(f"""
WITH r AS (SELECT *, lower(t) AS e, rid % 2 = 0 AS sup, rid % 3 = 0 AS first FROM ({REC})),
x AS (SELECT *, contains(e, 'возможно') OR contains(e, 'предлага') AS tentative, contains(e, 'решили') AS decided FROM r)
SELECT record_id, CASE WHEN kind = 'proposal' AND sup AND first THEN 'action' WHEN kind = 'decision' AND (tentative OR NOT decided) THEN 'proposal' WHEN kind = 'action' AND NOT sup AND e LIKE 'работаю%' THEN 'current_state'
    WHEN kind = 'action' AND NOT sup THEN 'proposal' ELSE kind END AS type,
  CASE WHEN kind = 'proposal' AND sup AND first THEN CASE WHEN tentative THEN 'tentative' ELSE 'explicit' END WHEN kind = 'decision' AND (tentative OR NOT decided) THEN 'tentative' WHEN kind = 'action' AND NOT sup AND e LIKE 'работаю%' THEN 'certain'
    WHEN kind = 'action' AND NOT sup THEN 'tentative' ELSE 'certain' END AS certainty,
  CASE WHEN kind = 'proposal' AND sup AND first THEN 'explicit_commitment_promoted' WHEN kind = 'decision' AND (tentative OR NOT decided) THEN 'decision_downgraded' WHEN kind = 'action' AND NOT sup AND e LIKE 'работаю%' THEN 'action_retyped_in_progress'
    WHEN kind = 'action' AND NOT sup THEN 'action_downgraded' END AS policy_note
FROM x
""")
def fact_policy(spark, sf_dir):
    """P04."""
    r = records(spark, sf_dir).select("record_id", "rid", F.col("kind").alias("type"), F.col("t").alias("evidence_text"), F.lit("certain").alias("certainty"))
    return X.enforce_policy(r, F.col("rid") % 2 == 0, F.col("rid") % 3 == 0).select("record_id", "type", "certainty", "policy_note")


@query(f"""
WITH r AS ({REC})
SELECT record_id, CASE WHEN kind = 'question' THEN 'question' WHEN t LIKE 'Работаю%' THEN 'current_state' WHEN t LIKE 'Возможно%' OR t LIKE '%гипотез%' THEN 'hypothesis' WHEN t LIKE 'Предлагаю%' THEN 'proposal' ELSE 'observation' END AS type, 'retyped' AS validation
FROM r WHERE rid % 2 = 0
""")
def fact_retyping(spark, sf_dir):
    """Rejections about the type, every other one for another reason."""
    r = records(spark, sf_dir).select("record_id", F.col("kind").alias("type"), F.col("t").alias("evidence_text"), F.when(F.col("rid") % 2 == 0, "Неверный тип").otherwise("нет опоры").alias("reason"))
    return X.retype_rejected(r, "reason", F.col("type") == "question").select("record_id", "type", "validation")


REVIEW = "CASE rid % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'corrected' WHEN 2 THEN 'retype' WHEN 3 THEN 'reject' END"


@query(f"""
WITH r AS (SELECT *, {REVIEW} AS v FROM ({REC}))
SELECT record_id, CASE WHEN v = 'corrected' THEN o ELSE t END AS statement, CASE WHEN v IN ('corrected', 'retype') THEN 'metric' ELSE kind END AS type, coalesce(v, 'quarantined') AS validation FROM r
""")
def fact_reviews(spark, sf_dir):
    """Accepted and rejected facts together; the fifth of each five has no review."""
    r = records(spark, sf_dir)
    facts = r.select(F.col("record_id").alias("fact_id"), F.col("kind").alias("type"), F.col("t").alias("statement"))
    verdict = F.get(F.array(*map(F.lit, ("supported", "corrected", "retype", "reject"))), (F.col("rid") % 5).cast("int"))
    reviews = r.where("rid % 5 < 4").select(F.col("record_id").alias("fact_id"), verdict.alias("verdict"), F.col("o").alias("statement"), F.lit("metric").alias("type"))
    kept, rejected = X.apply_reviews(facts, reviews)
    return kept.unionByName(rejected).select(F.col("fact_id").alias("record_id"), "statement", "type", "validation")


@query(f"""
WITH r AS ({REC}),
a AS (SELECT *, CASE WHEN rid % 3 = 0 THEN 'corrected' ELSE 'supported' END AS av, CASE WHEN rid % 3 = 0 OR rid % 7 = 0 THEN 'corrected' ELSE 'supported' END AS bv, CASE WHEN rid % 11 = 0 THEN 'metric' ELSE kind END AS bk,
  CASE WHEN rid % 5 = 0 THEN o ELSE upper(t) END AS bt, 0.9 - (rid % 4) / 10.0::DOUBLE AS ac, 0.8 AS bc FROM r),
c AS (SELECT *, CASE WHEN rid % 13 = 0 THEN 'critical_verifier_disagreement' WHEN av <> bv THEN 'critical_verdict_mismatch' WHEN kind <> bk THEN 'critical_type_mismatch'
  WHEN av = 'corrected' AND {SQUEEZED.format("t")} <> {SQUEEZED.format("bt")} THEN 'critical_correction_mismatch' END AS reason FROM a)
SELECT record_id, reason, CASE WHEN reason IS NULL THEN least(ac, bc::DOUBLE) ELSE 0.2 END AS confidence, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN av = 'corrected' THEN 'dual_corrected' ELSE 'dual_supported' END AS validation FROM c
""")
def dual_review(spark, sf_dir):
    """P08."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    facts = r.select(F.col("record_id").alias("fact_id"), F.col("kind").alias("type"), F.col("t").alias("statement"), F.array("record_id").alias("evidence_ids"))
    first = r.select(F.col("record_id").alias("fact_id"), F.when(rid % 3 == 0, "corrected").otherwise("supported").alias("validation"), F.col("kind").alias("type"), F.col("t").alias("statement"), F.array(F.lit("a"), F.lit("b")).alias("evidence_ids"), (0.9 - (rid % 4) / 10.0).alias("confidence"))
    second = r.where("rid % 13 <> 0").select(F.col("record_id").alias("fact_id"), F.when((rid % 3 == 0) | (rid % 7 == 0), "corrected").otherwise("supported").alias("validation"), F.when(rid % 11 == 0, "metric").otherwise(F.col("kind")).alias("type"), F.when(rid % 5 == 0, F.col("o")).otherwise(F.upper("t")).alias("statement"), F.array(F.lit("b"), F.lit("a")).alias("evidence_ids"), F.lit(0.8).alias("confidence"))
    return X.dual_review(facts, first, second).select(F.col("fact_id").alias("record_id"), "reason", "confidence", "validation")


@query(f"""
WITH r AS (SELECT *, rid % 3 = 0 AS within, CASE rid % 2 WHEN 0 THEN 'resolved' ELSE 'open' END AS st FROM ({REC})),
l AS (SELECT DISTINCT q.record_id, k, a.record_id AS a FROM r AS q, (VALUES (1), (2), (20)) AS v(k), r AS a WHERE q.kind = 'question' AND a.rid = q.rid + k AND a.start - q.start BETWEEN 0 AND 60),
v AS (SELECT record_id, string_agg(a, ',' ORDER BY k) AS answers FROM l GROUP BY 1)
SELECT r.record_id, coalesce(answers, '') AS answers, CASE WHEN kind <> 'question' THEN st WHEN answers IS NOT NULL OR within THEN 'resolved' WHEN st = 'resolved' THEN 'unclear' ELSE st END AS question_status,
  CASE WHEN kind = 'question' AND answers IS NOT NULL THEN 'cross_fact' WHEN kind = 'question' AND within THEN 'within_fact_evidence' END AS answer_resolution_basis
FROM r LEFT JOIN v USING (record_id)
""")
def question_links(spark, sf_dir):
    """Questions name the records one, two and twenty on; answers may come within a minute."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    rec = r.select("record_id", "kind", F.array(*[ident("R", rid + k) for k in (1, 2, 20, 1)]).alias("answer_record_ids"), F.when(rid % 3 == 0, F.array(F.lit("e"))).otherwise(empty()).alias("answer_evidence_ids"), F.when(rid % 2 == 0, "resolved").otherwise("open").alias("question_status"), F.lit(None).cast("string").alias("answer_resolution_basis"))
    out = X.question_links(rec, r.select(F.col("record_id").alias("fact_id"), "start"), 60.0)
    return out.select("record_id", F.array_join("answer_record_ids", ",").alias("answers"), "question_status", "answer_resolution_basis")


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start, record_id) AS n, {TOKENS.format("t || ' ' || speaker")} AS w FROM ({REC})),
j AS (SELECT q.meeting_id, q.record_id AS question_id, c.record_id AS candidate_id, c.start AS s, c.n - q.n AS off, c.start - q.start AS wait,
  2.2 / (1 + c.n - q.n) + 1.2 * exp(-(c.start - q.start) / 240) + 1.5 * (len(list_intersect(q.w, c.w)) / greatest(1, least(len(q.w), len(c.w)))::DOUBLE) + CASE WHEN q.speaker <> '' AND q.speaker = c.speaker THEN 1.0 ELSE 0 END + CASE WHEN c.kind = 'decision' THEN 0.35 ELSE 0 END AS score
  FROM r AS q JOIN r AS c ON q.meeting_id = c.meeting_id AND q.kind = 'question' AND c.n BETWEEN q.n + 1 AND q.n + 60 AND c.start - q.start BETWEEN 0 AND 900 AND NOT (c.kind = 'question' AND c.n - q.n > 3)),
k AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, question_id ORDER BY round(score, 9) DESC, s, candidate_id) AS rank FROM j WHERE off <= 12 OR wait <= 90 OR score >= 1.25)
SELECT meeting_id, question_id, candidate_id, round(score, 9) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 4
""")
def question_bundles(spark, sf_dir):
    """J10."""
    r = records(spark, sf_dir).select("meeting_id", "record_id", "kind", "start", F.col("t").alias("statement"), F.col("speaker").alias("subject"), F.when(F.col("kind") == "decision", "decide").otherwise("none").alias("speech_act"))
    return X.question_bundles(r, ["meeting_id"], limit=4).withColumn("score", F.round("score", 9))


@query(f"""
WITH r AS ({REC})
SELECT record_id, CASE WHEN rid % 4 = 0 THEN 'missing' WHEN t = o OR rid % 4 = 1 THEN 'confirmed' ELSE 'mismatch' END AS status FROM r
WHERE rid % 4 < 2 OR regexp_matches(t, '[0-9]') <> regexp_matches(o, '[0-9]')
""")
def repaired_evidence(spark, sf_dir):
    """No repair, one that changes nothing, one of another phrase with or without a number."""
    r = records(spark, sf_dir)
    digits = lambda c: F.col(c).rlike("[0-9]")
    r = r.where((F.col("rid") % 4 < 2) | (digits("t") != digits("o")))
    repairs = r.where("rid % 4 <> 0").select(F.col("record_id").alias("evidence_id"), F.when(F.col("rid") % 4 == 1, F.col("t")).otherwise(F.col("o")).alias("text"))
    return X.reconcile_repairs(r.select(F.col("record_id").alias("evidence_id"), F.col("t").alias("text")), repairs).select(F.col("evidence_id").alias("record_id"), "status")


@query(f"""
WITH r AS (SELECT *, CASE rid % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS risk FROM ({REC})),
e AS (SELECT f.record_id AS fact_id, f.risk <> 'CRITICAL' AS low, f.start AS b, g.record_id AS evidence_id, g.start AS s, g."end" AS e FROM r AS f JOIN r AS g ON g.rid IN (f.rid, f.rid + 1) WHERE f.risk <> 'LOW'),
p AS (SELECT evidence_id, any_value(s) AS s, any_value(e) AS e, min(row(low, b, fact_id)) AS o, string_agg(fact_id, ',' ORDER BY low, b, fact_id) AS fact_ids FROM e GROUP BY 1)
SELECT evidence_id, fact_ids, greatest(0.0::DOUBLE, s - 2) AS start, e + 4 AS "end" FROM p ORDER BY o, evidence_id LIMIT 24
""")
def repair_requests(spark, sf_dir):
    """T02, a top-k report."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    facts = r.select(F.col("record_id").alias("fact_id"), F.when(rid % 4 == 0, "CRITICAL").when(rid % 4 == 1, "HIGH").otherwise("LOW").alias("risk_level"), "start", F.array("record_id", ident("R", rid + 1)).alias("evidence_ids"))
    out = X.repair_requests(facts, r.select(F.col("record_id").alias("evidence_id"), "start", "end"))
    return out.withColumn("fact_ids", F.array_join("fact_ids", ","))


@query(f"""
WITH r AS (SELECT *, rid % 3 = 0 AS mandatory, CASE rid % 2 WHEN 0 THEN 'accepted' ELSE 'proposed' END AS st, CASE WHEN rid % 5 < 3 THEN rid % 5 = 0 END AS ok,
  CASE kind WHEN 'action' THEN 'task' ELSE kind END AS k FROM ({REC}))
SELECT record_id, CASE WHEN coalesce(ok, false) THEN 'retained' WHEN mandatory OR (k = 'task' AND st = 'accepted') OR (k = 'decision' AND st = 'accepted') OR k IN ('blocker', 'question') THEN 'protected' ELSE 'rejected' END AS part FROM r
""")
def public_partition(spark, sf_dir):
    """P12 P13."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    items = r.select(F.col("record_id").alias("item_key"), (rid % 3 == 0).alias("mandatory"), F.when(F.col("kind") == "action", "task").otherwise(F.col("kind")).alias("kind"), F.when(rid % 2 == 0, "accepted").otherwise("proposed").alias("status"))
    kept, rejected, protected = X.partition_public(items, r.where("rid % 5 < 3").select(F.col("record_id").alias("item_key"), (rid % 5 == 0).alias("ok")))
    part = lambda df, name: df.select(F.col("item_key").alias("record_id"), F.lit(name).alias("part"))
    return part(kept, "retained").unionByName(part(protected, "protected")).unionByName(part(rejected.join(protected, "item_key", "left_anti"), "rejected"))


@query(f"""
WITH r AS (SELECT *, CASE WHEN rid % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS st, CASE WHEN rid % 4 = 0 THEN 'stale' ELSE 'active' END AS life FROM ({REC}))
SELECT record_id, life = 'active' AND st = 'accepted' AND CASE WHEN kind = 'decision' THEN rid % 3 <> 0 ELSE rid % 2 = 0 END AS publishable FROM r
""")
def publishable_decisions(spark, sf_dir):
    """P10: decisions by their acceptance check, others by evidence apart from the acceptance."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    item = r.select(
        "record_id", F.when(rid % 4 == 0, "stale").otherwise("active").alias("lifecycle"), F.when(rid % 5 == 0, "rejected").otherwise("accepted").alias("decision_status"), F.array("record_id").alias("decision_evidence_ids"), F.col("kind").alias("content_kind"),
        F.lit(None).cast("string").alias("speech_act"), F.when(rid % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("evidence_ids"), F.array(F.lit("a")).alias("acceptance_evidence_ids"), F.when(rid % 3 == 0, "contradicted").when(rid % 3 == 1, "entailed").alias("acceptance_check"),
    )
    return item.select("record_id", X.publishable_decision(item).alias("publishable"))


@query(f"""
WITH r AS ({REC}), c AS (SELECT u.rid, u.record_id AS unit_id, s.record_id AS source_id FROM r AS u, (VALUES (0), (1)) AS v(k), r AS s WHERE s.rid = u.rid + k),
d AS (SELECT DISTINCT record_id AS unit_id FROM r AS x, (VALUES (0), (1)) AS v(k) WHERE x.rid % 2 = 0 AND NOT EXISTS (SELECT 1 FROM r AS y WHERE y.rid = x.rid + v.k))
SELECT 'unknown source' AS kind, 'R' || (rid + 1) AS id FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS y WHERE y.rid = r.rid + 1)
UNION ALL SELECT 'repeated unit', record_id FROM r WHERE rid % 9 = 0
UNION ALL SELECT 'accounted', record_id FROM r WHERE rid % 6 <> 1
""")
def inventory_faults(spark, sf_dir):
    """Units cite their record and the next; every ninth unit comes twice."""
    r = records(spark, sf_dir)
    unit = r.select(F.col("record_id").alias("unit_id"), F.array("record_id", ident("R", F.col("rid") + 1)).alias("source_ids"), "rid")
    units = unit.unionByName(unit.where("rid % 9 = 0")).drop("rid")
    return X.check_inventory(units, r.select(F.col("record_id").alias("source_id"), (F.col("rid") % 6).cast("int").alias("accounts")))


@query(f"""
WITH RECURSIVE r AS ({REC}),
bad AS (SELECT record_id, rid FROM r WHERE rid % 17 = 0),
g AS (SELECT rid FROM bad UNION SELECT r.rid FROM r JOIN g ON r.rid = g.rid + 1 AND r.rid % 5 <> 0)
SELECT record_id, CASE WHEN rid % 17 = 0 THEN 'unknown source' WHEN rid IN (SELECT rid FROM g) THEN 'depends on a discarded unit' ELSE 'kept' END AS reason FROM r
""")
def inventory_salvage(spark, sf_dir):
    """Units depend on the one before, but for every fifth; every seventeenth cites an unknown source."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    sources = F.when(rid % 17 == 0, F.array("record_id", F.lit("none"))).otherwise(F.array("record_id"))
    before = r.select((rid + 1).alias("rid"), F.col("record_id").alias("prior"))
    units = r.join(before, "rid", "left").select(F.col("record_id").alias("unit_id"), sources.alias("source_ids"), F.when((rid % 5 != 0) & F.col("prior").isNotNull(), F.array("prior")).otherwise(empty()).alias("depends_on"))
    kept, gone, _ = X.salvage_inventory(units, r.select(F.col("record_id").alias("source_id")))
    return kept.select(F.col("unit_id").alias("record_id"), F.lit("kept").alias("reason")).unionByName(gone.select(F.col("unit_id").alias("record_id"), "reason"))


@query(f"""
WITH r AS ({REC})
SELECT 'all' AS "view", record_id FROM r WHERE rid % 2 = 0
UNION ALL SELECT 'work', record_id FROM r WHERE rid % 2 = 0 AND kind IN ('action', 'blocker')
UNION ALL SELECT * FROM (SELECT 'first decisions', record_id FROM r WHERE rid % 2 = 0 AND kind = 'decision' ORDER BY start, record_id LIMIT 5)
""")
def claim_views(spark, sf_dir):
    """P20; one view is a top-k report."""
    r = records(spark, sf_dir).select(F.col("record_id").alias("claim_id"), F.col("kind").alias("content_kind"), "start", "rid")
    v = X.views(r, r.where("rid % 2 = 0"), {"all": None, "work": ["action", "blocker"], "first decisions": ["decision"]}, {"first decisions": 5})
    return v.select("view", F.col("claim_id").alias("record_id"))


@query(f"""
WITH r AS ({REC}), b AS (SELECT meeting_id, string_agg(record_id, ',' ORDER BY start, record_id) AS events FROM r GROUP BY 1)
SELECT b.meeting_id, events, string_agg(DISTINCT 'L' || r.rid, ',' ORDER BY 'L' || r.rid) FILTER (EXISTS (SELECT 1 FROM r AS y WHERE y.rid = r.rid + 1)) AS relations FROM b JOIN r USING (meeting_id) GROUP BY ALL
""")
def dialogue_bundles(spark, sf_dir):
    """A meeting's records are its claims; relations go from each record to the next."""
    r = records(spark, sf_dir)
    episodes = r.groupBy("meeting_id").agg(F.collect_list("record_id").alias("claim_ids")).withColumn("episode_id", ident("E", F.col("meeting_id")))
    events = r.select(F.col("record_id").alias("claim_id"), F.col("record_id").alias("event_id"), "start", F.array("record_id").alias("evidence_ids"))
    nxt = r.select((F.col("rid") - 1).alias("rid"), F.col("record_id").alias("target_claim_id"))
    relations = r.join(nxt, "rid").select(ident("L", F.col("rid")).alias("relation_id"), F.col("record_id").alias("source_claim_id"), "target_claim_id", F.array("record_id").alias("evidence_ids"))
    out = X.dialogue_bundles(episodes, events, relations)
    joined = F.array_join("relation_ids", ",")
    return out.select("meeting_id", F.array_join("event_ids", ",").alias("events"), F.when(joined != "", joined).alias("relations"))


@query(f"""
WITH r AS ({REC})
SELECT meeting_id, arg_max(record_id, row(start, record_id)) FILTER (kind IN ('decision', 'proposal')) AS outcome, arg_max(record_id, row(start, record_id)) FILTER (kind = 'blocker') AS problem FROM r GROUP BY 1
""")
def outcome_cards(spark, sf_dir):
    """J20."""
    r = records(spark, sf_dir)
    claims = r.select(F.col("meeting_id").alias("bundle_id"), F.col("record_id").alias("claim_id"), F.col("kind").alias("content_kind"), "start", F.lit(0).alias("status_rank"), F.array("record_id").alias("evidence_ids"))
    return X.outcome_cards(claims.select("bundle_id").distinct(), claims, {"outcome": ["decision", "proposal"], "problem": ["blocker"]}).withColumnRenamed("bundle_id", "meeting_id")


@query(f"""
WITH r AS (SELECT *, {SQUEEZED.format("t")} AS sq FROM ({REC})), c AS (SELECT * FROM r WHERE rid % 2 = 0), k AS (SELECT * FROM r WHERE rid % 2 = 1),
a AS (SELECT c.record_id AS candidate_id, k.record_id AS claim_id, 'origin' AS rule FROM c JOIN k ON c.rid % 3 = 0 AND k.rid = c.rid + 1),
b AS (SELECT c.record_id, k.record_id, 'lineage' FROM c JOIN k ON c.rid % 5 = 0 AND k.rid = c.rid + 3 WHERE c.record_id NOT IN (SELECT candidate_id FROM a)),
d AS (SELECT c.record_id, k.record_id, 'text' FROM c JOIN k ON c.sq = k.sq AND c.meeting_id = k.meeting_id WHERE c.record_id NOT IN (SELECT candidate_id FROM a) AND c.record_id NOT IN (SELECT record_id FROM b))
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d
""")
def matched_claims(spark, sf_dir):
    """Even records against odd ones, by origin, lineage, or equal text in one meeting."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    same = [F.col("t").alias("statement"), F.array(F.col("meeting_id").cast("string")).alias("evidence_ids")]
    cand = r.where("rid % 2 = 0").select(F.col("record_id").alias("candidate_id"), F.when(rid % 3 == 0, rid + 1).alias("origin_id"), F.when(rid % 5 == 0, rid + 3).alias("lineage_id"), *same)
    claims = r.where("rid % 2 = 1").select(F.col("record_id").alias("claim_id"), rid.alias("origin_id"), rid.alias("lineage_id"), *same)
    return X.match_claims(cand, claims)


@query(f"""
WITH r AS (SELECT *, {TOKENS.format("t")} AS w FROM ({REC})),
s AS (SELECT *, CASE kind WHEN 'decision' THEN 3.0 WHEN 'action' THEN 3.0 WHEN 'question' THEN 0.6 WHEN 'hypothesis' THEN 1.8 WHEN 'proposal' THEN 2.0 WHEN 'observation' THEN 1.0 ELSE 0.8 END
  + CASE WHEN regexp_matches(lower(t), 'подготов|провер') THEN 0.7 ELSE 0 END + CASE WHEN regexp_matches(t, '[0-9]') THEN 0.45 ELSE 0 END + CASE WHEN len(w) >= 8 THEN 0.25 ELSE 0 END + least(0.75, (rid % 6) * 0.2) - CASE WHEN rid % 4 = 0 THEN 1.2 ELSE 0 END
  - CASE WHEN t IN ('Нет', 'угу, ладно', 'спасибо') THEN 5.0 ELSE 0 END - CASE WHEN kind = 'hypothesis' AND NOT (t LIKE 'Предлагаю%' OR t LIKE 'Возможно%' OR t LIKE 'Нужно проверить%') THEN 4.0 ELSE 0 END AS salience FROM r)
SELECT record_id, round(salience, 4)::DOUBLE AS salience FROM s
""")
def fact_salience(spark, sf_dir):
    """T04."""
    r = records(spark, sf_dir)
    return r.select("record_id", X.salience("t", "kind", relations=(F.col("rid") % 6).cast("int"), needs_review=F.col("rid") % 4 == 0).alias("salience"))


@query(f"""
WITH r AS (SELECT *, regexp_extract_all(lower(t), '[a-zа-яё0-9]+') AS w0, regexp_extract_all(lower(o), '[a-zа-яё0-9]+') AS w1 FROM ({REC})),
x AS (SELECT *, list_distinct(w0) AS a, list_distinct(w1) AS b FROM r)
SELECT record_id, (rid % 3 = 0 OR rid % 2 = 0) AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / greatest(1, least(len(a), len(b)))::DOUBLE >= 0.1 AS same FROM x
""")
def equivalent_statements(spark, sf_dir):
    """F16: a typed field that is empty on one side, equal, or not."""
    rid = F.col("rid")
    r = records(spark, sf_dir).select("record_id", F.col("t").alias("a_statement"), F.col("o").alias("b_statement"), F.when(rid % 3 == 0, "").otherwise("x").alias("a_unit"), F.when(rid % 2 == 0, "x").otherwise("y").alias("b_unit"))
    return r.select("record_id", X.equivalent("a_", "b_", ["unit"], (), 0.1).alias("same"))


@query(f"SELECT record_id, NOT EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)?')) AS x) WHERE NOT list_contains(regexp_extract_all(o, '[0-9]+(?:[.,][0-9]+)?'), x)) AND NOT contains(t, '@') AND NOT regexp_matches(t, 'GPU4|_final') AS grounded FROM ({REC})")
def grounded_statements(spark, sf_dir):
    """Whether another phrase has all numbers, names and technical words of a phrase."""
    from .functions import scalars as S

    return records(spark, sf_dir).select("record_id", S.grounded("t", "o").alias("grounded"))


@query(f"WITH r AS ({REC}) SELECT record_id FROM r WHERE EXISTS (SELECT 1 FROM r AS y WHERE y.meeting_id = r.meeting_id AND y.kind = r.kind AND y.rid % 3 = 0)")
def existing_partners(spark, sf_dir):
    """Records whose meeting has one of the same kind among every third."""
    r = records(spark, sf_dir)
    return X.existing(r, r.select("meeting_id", "kind", F.col("rid").alias("n")), ["meeting_id", "kind"], F.col("n") % 3 == 0).select("record_id")


# ---------------------------------------------------------------- state


EDGE = ("corrects", "rejects", "supersedes", "contradicts", "supports", "unknown")


def edges(r: DataFrame) -> DataFrame:
    """From each record to the one before: a relation of a kind by number; every tenth to itself."""
    rid = F.col("rid")
    kind = F.get(F.array(*map(F.lit, EDGE)), (rid % 6).cast("int"))
    target = F.when(rid % 10 == 0, F.col("record_id")).otherwise(ident("R", rid - 1))
    return r.select(ident("L", rid).alias("relation_id"), F.col("record_id").alias("source_claim_id"), target.alias("target_claim_id"), kind.alias("type"), F.when(rid % 7 == 0, empty()).otherwise(F.array("record_id", "record_id")).alias("evidence_ids"))


EDGES = f"SELECT 'L' || rid AS relation_id, record_id AS s, CASE WHEN rid % 10 = 0 THEN record_id ELSE 'R' || (rid - 1) END AS t, ([{', '.join(f"'{k}'" for k in EDGE)}])[rid % 6 + 1] AS type, rid % 7 <> 0 AS evidence FROM r"


@query(f"WITH r AS ({REC}), e AS ({EDGES}) SELECT relation_id, s AS source_claim_id, t AS target_claim_id, type FROM e WHERE type <> 'unknown' AND s <> t AND evidence AND t IN (SELECT record_id FROM r)")
def normalized_relations(spark, sf_dir):
    """P14."""
    r = records(spark, sf_dir)
    return G.normalize_relations(edges(r), r.select(F.col("record_id").alias("claim_id"))).select("relation_id", "source_claim_id", "target_claim_id", "type")


@query(f"""
WITH r AS ({REC}), e AS (SELECT * FROM ({EDGES}) WHERE type IN ('corrects', 'supersedes', 'rejects') AND t IN (SELECT record_id FROM r)),
x AS (SELECT relation_id, t AS id, 0 AS k, CASE WHEN type = 'rejects' THEN 'rejected' ELSE 'superseded' END AS l FROM e UNION ALL SELECT relation_id, s, 1, 'active' FROM e),
g AS (SELECT id, arg_max(l, row(relation_id, k)) AS l, string_agg(relation_id, ',' ORDER BY relation_id) FILTER (k = 0) AS basis FROM x GROUP BY 1)
SELECT record_id, coalesce(l, 'active') AS lifecycle, coalesce(basis, '') AS basis FROM r LEFT JOIN g ON id = record_id
""")
def reconciled_lifecycle(spark, sf_dir):
    """G06."""
    r = records(spark, sf_dir)
    out = G.reconcile_lifecycle(r.select(F.col("record_id").alias("claim_id")), edges(r))
    return out.select(F.col("claim_id").alias("record_id"), "lifecycle", F.array_join("lifecycle_basis", ",").alias("basis"))


@query(f"""
WITH r AS ({REC}), e AS ({EDGES}), f AS (SELECT DISTINCT t FROM e WHERE type IN ('corrects', 'supersedes', 'rejects'))
SELECT relation_id, least(s, t) || ',' || greatest(s, t) AS members, s IN (SELECT t FROM f) OR t IN (SELECT t FROM f) AS resolved FROM e WHERE type = 'contradicts'
""")
def conflict_sets(spark, sf_dir):
    """U07."""
    out = G.conflict_sets(edges(records(spark, sf_dir)))
    return out.withColumn("members", F.array_join("members", ","))


@query(f"""
WITH r AS ({REC}), m AS (SELECT meeting_id, (['accepts', 'rejects', 'decides', 'defers', 'corrects', 'notes', 'notes'])[rid % 7 + 1] AS type, start, record_id, speaker FROM r),
g AS (SELECT meeting_id, bool_or(type = 'corrects') AS over, arg_max(type, row(start, record_id)) FILTER (type IN ('accepts', 'rejects')) AS v, bool_or(type = 'decides') AS d, bool_or(type = 'defers') AS f, string_agg(DISTINCT speaker, ',' ORDER BY speaker) FILTER (type = 'accepts') AS accepted_by FROM m GROUP BY 1)
SELECT meeting_id, CASE WHEN over THEN 'superseded' WHEN v = 'accepts' THEN 'accepted' WHEN v = 'rejects' THEN 'rejected' WHEN d THEN 'accepted' WHEN f THEN 'deferred' ELSE 'candidate' END AS status, coalesce(accepted_by, '') AS accepted_by FROM g
""")
def reduced_decisions(spark, sf_dir):
    """Each meeting is a proposition, its turns are the moves."""
    r = records(spark, sf_dir)
    kind = F.get(F.array(*map(F.lit, ("accepts", "rejects", "decides", "defers", "corrects", "notes", "notes"))), (F.col("rid") % 7).cast("int"))
    moves = r.select(F.col("meeting_id").alias("proposition_id"), kind.alias("type"), F.col("start").alias("at"), F.col("record_id").alias("event_id"), F.col("speaker").alias("actor"))
    out = G.reduce_decisions(moves.select("proposition_id").distinct(), moves)
    return out.select(F.col("proposition_id").alias("meeting_id"), "status", F.array_join("accepted_by", ",").alias("accepted_by"))


@query(f"SELECT meeting_id, min(speaker) AS owner FROM ({REC}) WHERE t LIKE 'Я подготовлю%' GROUP BY 1 HAVING count(DISTINCT speaker) = 1")
def source_commitments(spark, sf_dir):
    """G05."""
    return G.source_commitments(records(spark, sf_dir), ["meeting_id"], text="t")


@query(f"""
WITH r AS ({REC}), u AS (SELECT meeting_id, rid // 3 AS u, count(DISTINCT rid // 2) AS e, bool_and(rid % 2 = 0) AS touched FROM r GROUP BY ALL)
SELECT meeting_id || '/' || u AS unit_id, e <= 1 OR touched AS allowed FROM u
""")
def cross_episode_units(spark, sf_dir):
    """Units of three records over episodes of two; relations touch even records."""
    r = records(spark, sf_dir)
    units = r.groupBy("meeting_id", F.floor(F.col("rid") / 3).alias("u")).agg(F.collect_list("record_id").alias("claim_ids"))
    units = units.select(F.concat_ws("/", "meeting_id", "u").alias("unit_id"), "claim_ids", F.transform("claim_ids", lambda x: F.concat(F.lit("L"), x)).alias("relation_ids"))
    relations = r.where("rid % 2 = 0").select(F.concat(F.lit("L"), F.col("record_id")).alias("relation_id"), F.col("record_id").alias("source_claim_id"), F.col("record_id").alias("target_claim_id"))
    return G.cross_episode_allowed(units, r.select(F.col("record_id").alias("claim_id"), F.floor(F.col("rid") / 2).alias("episode_id")), relations)


@query(f"""
WITH r AS ({REC}), c AS (SELECT *, CASE kind WHEN 'decision' THEN 'active_decisions' WHEN 'action' THEN 'active_tasks' WHEN 'question' THEN 'open_questions' WHEN 'hypothesis' THEN 'open_experiments' WHEN 'blocker' THEN 'blockers' END AS category FROM r),
p AS (SELECT category, t, min(record_id) AS claim_id FROM c WHERE rid % 3 = 0 AND category IS NOT NULL GROUP BY ALL),
n AS (SELECT category, t, max(record_id) AS claim_id FROM c WHERE rid % 3 = 1 AND rid % 4 <> 0 AND category IS NOT NULL AND NOT (category = 'open_questions' AND rid % 2 = 0) GROUP BY ALL)
SELECT category, t AS statement, claim_id FROM n UNION ALL SELECT category, t, claim_id FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.category = p.category AND n.t = p.t)
""")
def project_state(spark, sf_dir):
    """U04 R12."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    previous = r.where("rid % 3 = 0").withColumn("category", G.category(F.col("kind"))).where("category is not null").groupBy("category", F.col("t").alias("statement")).agg(F.min("record_id").alias("claim_id"))
    claims = r.where("rid % 3 = 1").select("kind", F.when(rid % 4 == 0, "stale").otherwise("active").alias("lifecycle"), F.when(rid % 2 == 0, "answered").alias("question_status"), F.col("t").alias("statement"), F.col("record_id").alias("claim_id"))
    return G.update_project_state(previous, claims)


@query(f"""
WITH r AS ({REC}), p AS (SELECT DISTINCT meeting_id, meeting_id AS pos FROM r), n AS (SELECT count(*) AS n FROM p)
SELECT rid AS surface_pos, CASE WHEN rid % 4 = 0 THEN rid % n ELSE pos END AS packet_pos FROM r JOIN p USING (meeting_id), n
""")
def assigned_surfaces(spark, sf_dir):
    """Packets hold a meeting's records; every fourth surface has none of them."""
    r = records(spark, sf_dir)
    packets = r.groupBy("meeting_id").agg(F.collect_list("record_id").alias("source_ids")).withColumn("packet_pos", F.col("meeting_id"))  # meetings are numbered from 0
    surfaces = r.select(F.col("rid").alias("surface_pos"), F.when(F.col("rid") % 4 == 0, F.array(F.lit("none"))).otherwise(F.array("record_id", F.lit("none"))).alias("source_ids"))
    return G.assign_surfaces(surfaces, packets.select("packet_pos", "source_ids")).select("surface_pos", "packet_pos")


@query(f"""
WITH r AS ({REC}), s AS (SELECT DISTINCT rid // 3 AS packet, x.k + rid AS source FROM r, (VALUES (0), (1)) AS x(k) WHERE rid % 5 <> 0)
SELECT r.record_id AS source_id, count(s.packet) AS n, CASE count(s.packet) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'repeated' END AS status FROM r LEFT JOIN s ON s.packet = r.rid // 3 AND s.source = r.rid GROUP BY r.record_id
""")
def united_inventories(spark, sf_dir):
    """Units of four records in five, each citing its record and the next."""
    r = records(spark, sf_dir)
    packet = ident("P", F.floor(F.col("rid") / 3))
    units = r.where("rid % 5 <> 0").select(packet.alias("packet_id"), F.col("record_id").alias("unit_id"), F.array("record_id", ident("R", F.col("rid") + 1)).alias("source_ids"))
    return G.union_inventories(units, r.select(packet.alias("packet_id"), F.col("record_id").alias("source_id")))


@query(f"""
WITH r AS (SELECT *, kind || turn AS family FROM ({REC})), g AS (SELECT * FROM r WHERE meeting_id <> 3), l AS (SELECT family, arg_max(t, row(meeting_id, record_id)) AS last FROM g GROUP BY 1)
SELECT meeting_id::VARCHAR AS meeting_id, record_id AS claim_id, family, 'old' AS change FROM g
UNION ALL SELECT '3', record_id, family, CASE WHEN last IS NULL THEN 'NEW' WHEN last <> t THEN 'CHANGED' ELSE 'CONFIRMS' END FROM (SELECT * FROM r WHERE meeting_id = 3) LEFT JOIN l USING (family)
""")
def versioned_graph(spark, sf_dir):
    """Meeting 3 is put in anew."""
    r = records(spark, sf_dir).withColumn("family", F.concat("kind", F.col("turn").cast("string")))
    rows = r.select(F.col("meeting_id").cast("string").alias("meeting_id"), F.col("record_id").alias("claim_id"), "family", F.col("t").alias("statement"), F.col("meeting_id").cast("int").alias("revision"), F.lit("old").alias("change"))
    new = rows.where("meeting_id = '3'").select("claim_id", "family", "statement")
    return G.versioned_upsert(rows, new, "3", 10_000).select("meeting_id", "claim_id", "family", "change")


@query(f"""
WITH r AS ({REC}), f AS (SELECT rid, CASE WHEN rid % 3 = 0 THEN 'new' || rid ELSE 'f' || rid END AS fp, meeting_id || '/' || turn % 3 AS an FROM r), s AS (SELECT rid, 'f' || rid AS fp, meeting_id || '/' || turn % 3 AS an FROM r WHERE rid % 4 <> 0),
e AS (SELECT f.rid, s.rid AS a FROM f JOIN s USING (fp)), lf AS (SELECT * FROM f WHERE rid NOT IN (SELECT rid FROM e)), ls AS (SELECT * FROM s WHERE rid NOT IN (SELECT a FROM e)),
k AS (SELECT x.rid, y.rid AS a FROM (SELECT an, min(rid) AS rid FROM lf GROUP BY an HAVING count(*) = 1) AS x JOIN (SELECT an, min(rid) AS rid FROM ls GROUP BY an HAVING count(*) = 1) AS y USING (an))
SELECT rid AS task_pos, 'A' || a AS action_id, 'same' AS outcome FROM e UNION ALL SELECT rid, 'A' || a, 'anchored' FROM k UNION ALL SELECT rid, NULL, 'new' FROM lf WHERE rid NOT IN (SELECT rid FROM k)
""")
def reconciled_tasks(spark, sf_dir):
    """R11."""
    r = records(spark, sf_dir)
    rid, anchor = F.col("rid"), F.concat_ws("/", "meeting_id", F.col("turn") % 3)
    fresh = r.select(rid.alias("task_pos"), F.when(rid % 3 == 0, ident("new", rid)).otherwise(ident("f", rid)).alias("fingerprint"), anchor.alias("anchor"))
    stored = r.where("rid % 4 <> 0").select(ident("A", rid).alias("action_id"), ident("f", rid).alias("fingerprint"), anchor.alias("anchor"), (rid % 2 == 0).alias("edited"))
    return G.reconcile_tasks(fresh, stored)


@query(f"SELECT record_id, CASE WHEN rid % 3 = 0 THEN 'kept ' || o ELSE t END AS t, kind, rid % 3 = 0 AS edited FROM ({REC})")
def task_overlay(spark, sf_dir):
    """R13."""
    r = records(spark, sf_dir)
    patches = r.where("rid % 3 = 0").select("record_id", F.concat(F.lit("kept "), "o").alias("t"), F.lit(None).cast("string").alias("kind"))
    return G.overlay(r.select("record_id", "t", "kind"), patches, "record_id", ["t", "kind"])


# ---------------------------------------------------------------- entities, answers, evidence


@query(f"""
WITH r AS ({REC}), a AS (SELECT {SQUEEZED.format("t")} AS alias, 'E' || (rid % 20) AS id FROM r WHERE rid % 2 = 0 UNION SELECT {SQUEEZED.format("o")}, 'E' || (rid % 20) FROM r WHERE rid % 6 = 0),
n AS (SELECT alias, list_sort(list_distinct(list(id))) AS ids FROM a WHERE alias <> '' GROUP BY 1), m AS (SELECT r.record_id, ids, list_filter(ids, lambda x: x = 'E' || (r.rid % 20)) AS near FROM r LEFT JOIN n ON n.alias = {SQUEEZED.format("r.t")})
SELECT record_id AS mention_id, CASE WHEN len(ids) = 1 THEN ids[1] WHEN len(near) = 1 THEN near[1] END AS entity_id FROM m
""")
def resolved_mentions(spark, sf_dir):
    """G13 G14."""
    r = records(spark, sf_dir)
    entity = ident("E", F.col("rid") % 20)
    entities = r.where("rid % 2 = 0").select(entity.alias("entity_id"), F.upper("t").alias("name"), F.when(F.col("rid") % 6 == 0, F.array("o")).alias("aliases"))
    return D.resolve_mentions(r.select(F.col("record_id").alias("mention_id"), F.col("t").alias("mention"), F.array(entity).alias("context_ids")), D.entity_aliases(entities))


@query(f"""
WITH r AS ({REC})
SELECT record_id, CASE v WHEN 'asserted' THEN 'certain' WHEN 'proposed' THEN 'possible' WHEN 'conditional' THEN 'conditional' ELSE CASE WHEN rid % 2 = 0 THEN 'speculative' ELSE 'certain' END END AS modality FROM (SELECT *, (['asserted', 'proposed', 'conditional', 'odd'])[rid % 4 + 1] AS v FROM r)
""")
def modality_axes(spark, sf_dir):
    """F11."""
    r = records(spark, sf_dir)
    value = F.get(F.array(*map(F.lit, ("asserted", "proposed", "conditional", "odd"))), (F.col("rid") % 4).cast("int"))
    return r.select("record_id", D.modality_axis(value, F.when(F.col("rid") % 2 == 0, "tentative")).alias("modality"))


@query(f"""
WITH r AS (SELECT *, {TOKENS.format("t")} AS w FROM ({REC})), j AS (SELECT a.meeting_id, a.record_id, b.record_id AS n_event_id, b.start AS s, 0.55 * CASE WHEN b.kind = 'decision' THEN 1.0 ELSE 0.25 END + 0.30 * (len(list_intersect(a.w, b.w)) / greatest(1, len(a.w))::DOUBLE) + 0.15 * (1 - (b.start - a.start) / 180) AS score
  FROM r AS a JOIN r AS b ON a.meeting_id = b.meeting_id AND a.kind = 'question' AND b.start >= a.start AND b.start - a.start <= 180)
SELECT record_id, n_event_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, record_id ORDER BY round(score, 12) DESC, s, n_event_id)::INTEGER AS rank FROM j) WHERE rank <= 8
""")
def answer_candidates(spark, sf_dir):
    """J09."""
    r = records(spark, sf_dir).select("meeting_id", F.col("record_id").alias("event_id"), "start", F.col("t").alias("text"), F.when(F.col("kind") == "decision", "answer").otherwise("x").alias("act"), "kind")
    out = M.answer_candidates(r.where("kind = 'question'"), r, ["meeting_id"])
    return out.select(F.col("event_id").alias("record_id"), "n_event_id", F.round("score", 9).alias("score"), "rank")


@query(f"""
WITH r AS ({REC}), q AS (SELECT {TOKENS.format("'проверить результат на серверах'")} AS q),
s AS (SELECT record_id, start, t, 3 * (len(list_intersect(q, {TOKENS.format("t")})) / greatest(1, len(q))::DOUBLE) + CASE WHEN rid % 4 = 0 THEN 0.2 ELSE 1.0 END + 1 / (1 + greatest(0, 5 - rid % 5))::DOUBLE AS score FROM r, q),
b AS (SELECT t, arg_max(record_id, row(round(score, 9), start, record_id)) AS claim_id, max(round(score, 9)) AS score, arg_max(start, row(round(score, 9), start, record_id)) AS start FROM s WHERE score > 0.25 GROUP BY t)
SELECT claim_id, score FROM b ORDER BY score DESC, start DESC, claim_id LIMIT 100
""")
def retrieved_claims(spark, sf_dir):
    """The best claim of each proposition; the limit is over their number."""
    r = records(spark, sf_dir)
    claims = r.select(F.col("record_id").alias("claim_id"), F.col("t").alias("proposition_id"), F.col("t").alias("statement"), "start", F.when(F.col("rid") % 4 == 0, "stale").alias("lifecycle"), (F.col("rid") % 5).alias("project_revision"), empty().alias("entity_names"), F.lit(None).cast("array<double>").alias("embedding"))
    return M.retrieve(claims, "проверить результат на серверах", limit=100, revision=5).select("claim_id", F.round("score", 9).alias("score"))


# ---------------------------------------------------------------- intervals, words, aggregates


@query(f"""
WITH t AS ({TIMED}), m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t WHERE "end" > start),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m),
u AS (SELECT user_id, max("end") - min(start) AS d FROM i GROUP BY user_id, k), s AS (SELECT user_id, sum(d) AS d FROM u GROUP BY 1), d AS (SELECT user_id, max("end") - min(start) AS total FROM t GROUP BY 1)
SELECT user_id, round(least(1.0, coalesce(s.d, 0) / greatest(1e-9, d.total::DOUBLE)), 12) AS coverage FROM d LEFT JOIN s USING (user_id)
""")
def time_coverage(spark, sf_dir):
    """A10."""
    t = timed(spark, sf_dir)
    total = t.groupBy("user_id").agg((F.max("end") - F.min("start")).cast("double").alias("duration"))
    return A.time_coverage(t, total, ["user_id"]).withColumn("coverage", F.round("coverage", 12))


@query(f"""
WITH t AS ({TIMED}), c AS (SELECT user_id, event_type, start, "end", row_number() OVER (PARTITION BY user_id, event_type ORDER BY start, "end") AS n, max("end") OVER (PARTITION BY user_id, event_type ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t WHERE "end" > start AND event_type IN ('view', 'error')),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY n) AS k FROM c), u AS (SELECT user_id, event_type, min(start) AS s, max("end") AS e FROM i GROUP BY user_id, event_type, k)
SELECT a.user_id, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS measure FROM u AS a JOIN u AS b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'error' AND a.s < b.e AND b.s < a.e GROUP BY 1
""")
def intersection_measure(spark, sf_dir):
    """A03."""
    t = timed(spark, sf_dir).select("user_id", "event_type", "start", "end")
    return I.intersection_measure(t.where("event_type = 'view'"), t.where("event_type = 'error'"), ["user_id"], 2 * HOUR)


@query(f"""
WITH t AS ({TIMED}), s AS (SELECT a.user_id, a.event_id, b.event_type AS l, sum(least(a."end", b."end") - greatest(a.start, b.start)) AS x FROM t AS a JOIN t AS b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type <> 'purchase' AND a.start < b."end" AND b.start < a."end" GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY x DESC, l) AS k FROM s), g AS (SELECT event_id, max(CASE WHEN k = 1 THEN l END) AS l, max(CASE WHEN k = 1 THEN x END) AS one, max(CASE WHEN k = 2 THEN x END) AS two FROM k GROUP BY 1)
SELECT t.event_id, CASE WHEN coalesce(one, 0) / greatest(0.04::DOUBLE, t."end" - t.start) >= 0.35 AND coalesce(one, 0) / greatest(0.04::DOUBLE, t."end" - t.start) - coalesce(two, 0) / greatest(0.04::DOUBLE, t."end" - t.start) >= 0.15 THEN l END AS label,
  round(coalesce(one, 0) / greatest(0.04::DOUBLE, t."end" - t.start), 9) AS share FROM t LEFT JOIN g USING (event_id) WHERE t.event_type = 'purchase'
""")
def assigned_labels(spark, sf_dir):
    """J02."""
    t = timed(spark, sf_dir)
    items = t.where("event_type = 'purchase'").select("user_id", "event_id", "start", "end")
    got = I.assign_labels(items, t.where("event_type <> 'purchase'").select("user_id", F.col("event_type").alias("label"), "start", "end"), ["user_id"], "event_id", "label", 2 * HOUR)
    return got.select("event_id", "label", F.round("share", 9).alias("share"))


@query(f"""
WITH t AS ({TIMED}), p AS (SELECT *, event_type AS l FROM t WHERE event_type IN ('view', 'click')), s AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END AS l FROM t WHERE event_type = 'error')
SELECT event_id FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND s.start < p."end" AND p.start < s."end") AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = p.user_id AND s.start < p."end" AND p.start < s."end" AND s.l = p.l)
""")
def disagreement_windows(spark, sf_dir):
    """J07."""
    t = timed(spark, sf_dir)
    p = t.where("event_type in ('view', 'click')").select("user_id", "event_id", "start", "end", F.col("event_type").alias("label"))
    s = t.where("event_type = 'error'").select("user_id", "start", "end", F.when(F.col("event_id") % 2 == 0, "view").otherwise("click").alias("label"))
    return I.disagreement_windows(p, s, ["user_id"], "label", 2 * HOUR).select("event_id")


@query(f"""
WITH w AS ({WORDS}), x AS (SELECT *, pos % 7 = 0 AS inferred, pos % 3 = 0 AS boundary FROM w)
SELECT conv_id, turn, min((pos % 10) / 10.0::DOUBLE) AS recognition, min((pos % 4) / 4.0::DOUBLE) AS speaker, concat_ws(',', CASE WHEN bool_or(boundary) THEN 'asr_boundary' END, CASE WHEN bool_or(inferred) THEN 'speaker_context' END) AS reasons,
  round_even(avg(inferred::INTEGER), 4) AS inferred_word_ratio, round_even(avg((inferred OR boundary)::INTEGER), 4) AS review_word_ratio FROM x GROUP BY ALL
""")
def word_uncertainty(spark, sf_dir):
    """A07 A08."""
    pos = F.col("pos")
    flags = F.array_compact(F.array(F.when(pos % 7 == 0, "speaker_context"), F.when(pos % 3 == 0, "asr_boundary")))
    w = words(spark, sf_dir).withColumn("flags", flags).withColumn("confidence", (pos % 10) / 10.0).withColumn("speaker_confidence", (pos % 4) / 4.0)
    out = A.uncertainty(w, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "recognition", "speaker", F.array_join("reasons", ",").alias("reasons"), "inferred_word_ratio", "review_word_ratio")


@query("""
WITH c AS (SELECT conv_id, turn % 2 AS side, coalesce(text, '') AS text, turn FROM conversations)
SELECT conv_id, side, count(*) AS n, count(DISTINCT replace(lower(text), 'ß', 'ss')) = 1 AS consensus, sha256(string_agg(text, '|' ORDER BY turn DESC, text DESC)) AS digest FROM c GROUP BY ALL
""")
def text_lattice(spark, sf_dir):
    """A conversation's turns of one side as alternatives, later ones better."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 2).alias("side"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("score"))
    out = A.lattice(c, ["conv_id", "side"])
    return out.select("conv_id", "side", F.size("alternatives").cast("long").alias("n"), "consensus", F.sha2(F.array_join("alternatives", "|"), 256).alias("digest"))


@query("SELECT o_custkey, sha256('[' || string_agg('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']') AS digest, count(*) AS n FROM orders GROUP BY 1")
def snapshot_digests(spark, sf_dir):
    """A21."""
    return A.snapshot_digest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"])


@query("SELECT p_partkey, p_size * p_retailprice * (p_partkey % 7) AS worth FROM part ORDER BY worth DESC, p_size, p_partkey LIMIT 20")
def ranked_repairs(spark, sf_dir):
    """T01, a top-k report."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("span_id"), F.col("p_size").alias("risk"), F.col("p_retailprice").alias("importance"), (F.col("p_partkey") % 7).alias("probability"), F.col("p_size").alias("start"))
    return A.ranked_repairs(p, 20).select(F.col("span_id").alias("p_partkey"), "worth")


@query(f"""
WITH r AS (SELECT * FROM ({REC}) WHERE rid % 4 <> 0),
b AS (SELECT ceil(sqrt(greatest(1.0, max("end") / 60)) + 1.5 * count(DISTINCT speaker) + count_if(rid % 97 = 0) + count(DISTINCT kind)) AS base FROM r),
v AS (SELECT * FROM (VALUES ('executive', 0.55::DOUBLE, 4, 8, 0.2::DOUBLE, 0.4::DOUBLE), ('rules', 0.35, 1, 6, 0.05, 0.25), ('technical', 0.85, 4, 12, 0.2, 0.55), ('tasks', 0.7, 3, 120, 0.15, 1.0), ('experiments', 0.8, 2, 10, 0.1, 0.4), ('questions', 0.7, 3, 10, 0.1, 0.4), ('minutes', 2.0, 7, 120, 1.0, 1.0)) AS t(view, f, lo, hi, a, b))
SELECT view, p AS policy, greatest(CASE WHEN p THEN greatest(1, ceil(10 * a)) ELSE lo END, least(CASE WHEN p THEN greatest(1, ceil(15 * v.b)) ELSE hi END, ceil(base * f)))::INTEGER AS budget FROM b, v, (VALUES (false), (true)) AS q(p)
""")
def adaptive_budget(spark, sf_dir):
    """All views, with their own bounds and with a policy of 10 to 15."""
    r = records(spark, sf_dir)
    claims = r.select("start", "end", F.col("speaker").alias("thread_id"), "kind", (F.col("rid") % 97 == 0).alias("mandatory"), F.when(F.col("rid") % 4 == 0, "stale").alias("lifecycle"))
    out = None
    for view in (*A.VIEW_SHARES, "minutes"):
        for policy in (None, (10, 15)):
            one = A.adaptive_budget(claims, 3, view=view, policy=policy).select(F.lit(view).alias("view"), F.lit(policy is not None).alias("policy"), "budget")
            out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH v AS (SELECT vec_id, vec_id % 5 AS g, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT vec_id AS profile, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 10),
s AS (SELECT g, vec_id, v.e, profile, list_dot_product(v.e, p.e) AS score FROM v, p),
a AS (SELECT * FROM (SELECT *, score - coalesce(lead(score) OVER w, -1) AS margin, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, profile)) WHERE k = 1),
f AS (SELECT *, score >= 0.2 AND margin >= 0.02 AS ok FROM a), u AS (SELECT g, profile, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM f WHERE ok AND score >= 0.2::DOUBLE + 0.08::DOUBLE AND margin >= 0.02::DOUBLE + 0.04::DOUBLE),
d AS (SELECT a.g, a.profile, a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e), 12) AS c, a.e AS ie, b.e AS je FROM u AS a JOIN u AS b ON a.g = b.g AND a.profile = b.profile),
m AS (SELECT g, profile, i, ie, list_sort(list(c))[count(*) // 2 + 1] AS med, count(*) AS n FROM d GROUP BY g, profile, i, ie), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, profile ORDER BY med DESC, ie) AS first FROM m) WHERE first = 1),
k AS (SELECT d.g, d.profile, d.je, row_number() OVER (PARTITION BY d.g, d.profile ORDER BY d.c, d.je) AS place, n FROM d JOIN best USING (g, profile, i)),
x AS (SELECT g, profile, q, avg(je[q + 1]) AS y FROM k, (SELECT unnest(range(64)) AS q) WHERE n < 3 OR place > n // 5 GROUP BY ALL), c AS (SELECT g, profile, list(y ORDER BY q) AS y FROM x GROUP BY ALL),
h AS (SELECT g, c.profile, list_transform(y, lambda z: z / sqrt(list_dot_product(y, y))) AS y, list_transform(p.e, lambda z: z / sqrt(list_dot_product(p.e, p.e))) AS pe FROM c JOIN p USING (profile)),
b AS (SELECT g, profile, list_transform(list_zip(y, pe), lambda z: (z[1] + z[2]) / 2) AS y FROM h), t AS (SELECT g, profile, list_transform(y, lambda z: z / sqrt(list_dot_product(y, y))) AS y FROM b),
r AS (SELECT * FROM (SELECT f.g, vec_id, t.profile AS np, list_dot_product(e, y) AS ns, row_number() OVER w AS nk, list_dot_product(e, y) - coalesce(lead(list_dot_product(e, y)) OVER w, -1) AS nl FROM f JOIN t ON t.g = f.g AND NOT ok WINDOW w AS (PARTITION BY f.g, vec_id ORDER BY list_dot_product(e, y) DESC, t.profile DESC)) WHERE nk = 1 AND ns >= 0.2 AND nl >= 0.02)
SELECT g, vec_id, coalesce(np, profile) AS profile_id, round(coalesce(ns, score), 6) AS score, ok OR np IS NOT NULL AS accepted, np IS NOT NULL AS session_prototype FROM f LEFT JOIN r USING (g, vec_id)
""")
def session_matches(spark, sf_dir):
    """J14, both passes: five sessions, ten profiles."""
    v = table(spark, sf_dir, "embeddings").withColumn("g", F.col("vec_id") % 5)
    profiles = v.where("vec_id < 10").select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("prototype"), F.array().cast("array<array<float>>").alias("references"))
    out = M.match_sessions(v, profiles, ["g"], "vec_id", "embedding", 0.2, 0.02)
    return out.select("g", "vec_id", "profile_id", F.round("score", 6).alias("score"), "accepted", "session_prototype")


@query("""
WITH v AS (SELECT vec_id, vec_id % 40 AS g, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, g, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE sqrt(list_dot_product(e, e)) > 1e-8),
d AS (SELECT a.g, a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e), 12) AS c, a.e AS ie, b.e AS je FROM u AS a JOIN u AS b ON a.g = b.g),
m AS (SELECT g, i, ie, list_sort(list(c))[count(*) // 2 + 1] AS med, count(*) AS n FROM d GROUP BY g, i, ie), best AS (SELECT g, i, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY med DESC, ie) AS first FROM m) WHERE first = 1),
k AS (SELECT d.g, d.j, row_number() OVER (PARTITION BY d.g ORDER BY d.c, d.je) AS place, n FROM d JOIN best ON best.g = d.g AND best.i = d.i),
x AS (SELECT u.g, p, avg(u.e[p + 1]) AS a FROM u JOIN k ON k.g = u.g AND k.j = u.vec_id, (SELECT unnest(range(64)) AS p) WHERE n < 3 OR place > n // 5 GROUP BY u.g, p)
SELECT g, p, round(a / sqrt(sum(a * a) OVER (PARTITION BY g)), 6) AS c FROM x
""")
def robust_centroids(spark, sf_dir):
    """Forty groups of vectors."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("g"), "embedding")
    return D.robust_centroid(v, ["g"], "embedding").select("g", F.posexplode("centroid").alias("p", "c")).select("g", F.col("p").cast("long").alias("p"), F.round("c", 6).alias("c"))


@query(f"""
WITH r AS (SELECT record_id, start, rid % 5 AS priority, t FROM ({REC})), m AS (SELECT 600.0::DOUBLE / 6 AS w),
i AS (SELECT r.*, row_number() OVER (PARTITION BY floor(start / w) ORDER BY priority, length(t) DESC, abs(start - (floor(start / w) + 0.5) * w), record_id) AS k FROM r, m WHERE start >= 0 AND start < 600),
f AS (SELECT * FROM i WHERE k <= 3), a AS (SELECT record_id, priority, t, start, 0 AS round FROM f UNION ALL SELECT record_id, priority, t, start, 1 FROM r WHERE record_id NOT IN (SELECT record_id FROM f))
SELECT record_id FROM a ORDER BY round, priority, length(t) DESC, start, record_id LIMIT 18
""")
def windowed_candidates(spark, sf_dir):
    """T11, a top-k report."""
    r = records(spark, sf_dir).select(F.col("record_id").alias("fact_id"), "start", (F.col("rid") % 5).alias("priority"), F.col("t").alias("text"))
    return A.windowed_candidates(r, 600.0).select(F.col("fact_id").alias("record_id"))


@query(f"""
WITH r AS ({REC}), s AS (SELECT meeting_id, turn, row_number() OVER (PARTITION BY meeting_id ORDER BY turn) AS k FROM r WHERE speaker = 'user'), o AS (SELECT meeting_id, record_id, row_number() OVER (PARTITION BY meeting_id ORDER BY length(t) DESC, turn) AS k FROM r WHERE speaker = 'user')
SELECT record_id, turn AS place FROM o JOIN s USING (meeting_id, k) UNION ALL SELECT record_id, turn FROM r WHERE speaker <> 'user'
""")
def reordered_section(spark, sf_dir):
    """T12."""
    r = records(spark, sf_dir).select("meeting_id", "record_id", "turn", "speaker", "t")
    return A.reordered_section(r, ["meeting_id"], "turn", F.col("speaker") == "user", [F.length("t").desc(), F.col("turn")]).select("record_id", "place")


@query("""
WITH a AS (SELECT o_custkey AS w, CAST(round(o_totalprice) AS BIGINT) AS r, CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice) AS BIGINT) // 2 END AS b, epoch(o_orderdate)::DOUBLE AS t, o_orderkey % 3 AS posts FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT max(epoch(o_orderdate)::DOUBLE) - 8640000 AS n FROM orders),
h AS (SELECT DISTINCT o_custkey AS w, 500000::BIGINT AS hold FROM orders WHERE o_custkey % 10 = 0)
SELECT (SELECT coalesce(sum(coalesce(b, r)), 0) FROM a, n WHERE (t >= n - 604800 OR (b IS NULL AND posts > 0)) AND w NOT IN (SELECT w FROM h)) + (SELECT sum(greatest(hold, x)) FROM (SELECT h.w, hold, (SELECT coalesce(sum(coalesce(b, r)), 0) FROM a WHERE a.w = h.w) AS x FROM h)) AS spent_microusd
""")
def spent_budget(spark, sf_dir):
    """Orders are attempts (a seventh rejected, a third never sent, open ones without a bill) a hundred days before the last; every tenth customer has a hold."""
    o = table(spark, sf_dir, "orders")
    amount, key = F.round("o_totalprice").cast("bigint"), F.col("o_orderkey")
    attempts = o.select(
        F.col("o_custkey").alias("workflow_id"), F.when(key % 7 == 0, "rejected_no_charge").otherwise("done").alias("status"), (key % 3).alias("posts"), amount.alias("reserved_microusd"), F.when(F.col("o_orderstatus") == "F", F.floor(amount / 2)).alias("billed_microusd"),
        F.col("o_orderdate").cast("timestamp").cast("double").alias("created_at"),
    )
    now = attempts.agg(F.max("created_at")).first()[0] - 8_640_000
    holds = attempts.select("workflow_id").where("workflow_id % 10 = 0").distinct().withColumn("hold_microusd", F.lit(500_000).cast("long"))
    return A.spent(attempts, holds, F.lit(now))


@query(f"""
WITH w AS ({WORDS}), f AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR start - lag("end") OVER o > 2.5 OR right(rtrim(lag(text) OVER o, ' '), 1) IN ('.', '?', '!', '…') THEN 1 ELSE 0 END AS f FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, pos, (sum(f) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS clause FROM f
""")
def clause_units(spark, sf_dir):
    """W02."""
    return Q.clauses(words(spark, sf_dir), ["conv_id"]).select("conv_id", "pos", F.col("clause").cast("bigint").alias("clause"))


@query(f"""
WITH w AS (SELECT *, CASE WHEN pos % 5 = 0 THEN 'b' ELSE 'a' END AS sp FROM ({WORDS})), d AS (SELECT *, greatest(0.04, "end" - start) AS d FROM w),
f AS (SELECT *, CASE WHEN sp = lag(sp) OVER o THEN 0 ELSE 1 END AS f FROM d WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)), r AS (SELECT *, sum(f) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM f),
l AS (SELECT *, sum(d) OVER (PARTITION BY conv_id, turn, run) AS len, max(run) OVER (PARTITION BY conv_id, turn) AS runs, sum(d) OVER (PARTITION BY conv_id, turn) AS total FROM r), b AS (SELECT conv_id, turn, arg_max(sp, row(x, -p)) AS best, max(x) AS x FROM (SELECT conv_id, turn, sp, sum(d) AS x, min(pos) AS p FROM r GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, pos, CASE WHEN runs > 1 AND x / total >= 0.55 AND len <= 1.2 THEN best ELSE sp END AS speaker, runs > 1 AND x / total >= 0.55 AND len <= 1.2 AND sp <> best AS smoothed FROM l JOIN b USING (conv_id, turn)
""")
def smoothed_speakers(spark, sf_dir):
    """A turn's words have another speaker at every fifth."""
    w = words(spark, sf_dir).withColumn("speaker", F.when(F.col("pos") % 5 == 0, "b").otherwise("a"))
    return Q.smooth(w, ["conv_id"], "turn").select("conv_id", "pos", "speaker", "smoothed")


@query(f"""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS k FROM ({WORDS})), old AS (SELECT * FROM w WHERE k <= 12), new AS (SELECT *, start + 0.05 AS s2, "end" + 0.05 AS e2, turn::DOUBLE * 60 + 2.5 AS cs, turn::DOUBLE * 60 + 12 * 0.33::DOUBLE AS pe FROM w WHERE k > 8),
x AS (SELECT *, s2 >= cs - 0.1 AND e2 <= pe + 0.1 AND pe > cs AS inside, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g') AS key FROM new), o AS (SELECT *, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g') AS key FROM old)
SELECT conv_id, turn, pos, CASE WHEN inside THEN 'asr_boundary' ELSE '' END AS flags FROM x WHERE NOT (inside AND EXISTS (SELECT 1 FROM o WHERE o.conv_id = x.conv_id AND o.turn = x.turn AND o.key = x.key AND abs(x.s2 - o.start) < 0.25 AND abs(x.e2 - o."end") < 0.35 AND o.start >= x.cs - 0.1 AND o."end" <= x.pe + 0.1))
""")
def repeated_words(spark, sf_dir):
    """A turn in two chunks that overlap by four words, heard a little later the second time."""
    from pyspark.sql import Window

    w = words(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")))
    new = w.where("k > 8").withColumn("start", F.col("start") + 0.05).withColumn("end", F.col("end") + 0.05).withColumn("chunk_start", F.col("turn") * 60.0 + 2.5).withColumn("previous_end", F.col("turn") * 60.0 + 12 * 0.33)
    return Q.without_repeats(w.where("k <= 12"), new, ["conv_id", "turn"]).select("conv_id", "turn", "pos", F.array_join("flags", ",").alias("flags"))


@query("""
WITH d AS (SELECT doc_id, n_chars, unnest(range(0, greatest(0, floor(n_chars / 500.0)::BIGINT) + 1)) * 500.0::DOUBLE AS s FROM documents WHERE n_chars IS NOT NULL)
SELECT doc_id, s AS range_start, least(s + 800, n_chars)::DOUBLE AS range_end FROM d WHERE least(s + 800, n_chars) - s >= 100
""")
def sliding_ranges(spark, sf_dir):
    """W23 W24."""
    d = table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", "n_chars")
    return Q.sliding_ranges(d, "n_chars", 800.0, 500.0, 100.0).select("doc_id", "range_start", "range_end")


# ---------------------------------------------------------------- metrics


@query(f"""
WITH r AS ({REC}), p AS (SELECT a.record_id AS rr, b.record_id AS hh, a.kind = b.kind AS k, a.speaker = b.speaker AS s FROM r AS a JOIN r AS b ON a.rid % 2 = 0 AND b.rid = a.rid + 1 AND a.rid % 3 <> 0)
SELECT count(DISTINCT hh) / (SELECT count(*) FROM r WHERE rid % 2 = 1)::DOUBLE AS claim_precision, count(DISTINCT rr) / (SELECT count(*) FROM r WHERE rid % 2 = 0)::DOUBLE AS claim_recall, avg(k::INTEGER) AS kind_agreement, avg(s::INTEGER) AS speaker_agreement FROM p
""")
def aligned_scores(spark, sf_dir):
    """E03 E09."""
    r = records(spark, sf_dir)
    alignment = r.where("rid % 2 = 0").select(F.col("record_id").alias("reference_id"), ident("R", F.col("rid") + 1).alias("hypothesis_id"), (F.col("rid") % 3 != 0).alias("supported"))
    return E.aligned_scores(r.where("rid % 2 = 0"), r.where("rid % 2 = 1"), alignment, ["kind", "speaker"]).drop("claim_f1")


@query("""
WITH l AS (SELECT event_type, unnest(['minutes', 'user']) AS metric, unnest([value, user_id::DOUBLE]) AS v FROM events)
SELECT metric, round(avg(v) FILTER (event_type = 'view'), 9) AS baseline, round(avg(v) FILTER (event_type = 'click'), 9) AS candidate, avg(v) FILTER (event_type = 'click') - avg(v) FILTER (event_type = 'view') > 0.05 AS regression FROM l GROUP BY 1
""")
def macro_averages(spark, sf_dir):
    """E05."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("minutes"), F.col("user_id").cast("double").alias("user"))
    return E.macro_averages(e, "event_type", ["minutes", "user"], "view", "click", 0.05).select("metric", F.round("baseline", 9).alias("baseline"), F.round("candidate", 9).alias("candidate"), "regression")


@query(f"""
WITH r AS (SELECT * FROM ({REC}) WHERE meeting_id < 40), e AS (SELECT * FROM r WHERE rid % 4 <> 3), p AS (SELECT * FROM r WHERE rid % 4 <> 0)
SELECT (SELECT count(*) FROM e WHERE rid % 2 = 0 AND rid IN (SELECT rid FROM p)) / (SELECT count(*) FROM e WHERE rid % 2 = 0)::DOUBLE AS mandatory_claim_recall, (SELECT count(*) FROM p WHERE rid IN (SELECT rid FROM e)) / (SELECT count(*) FROM p)::DOUBLE AS atomic_public_precision,
  (SELECT count(DISTINCT turn) FROM p WHERE turn IN (SELECT turn FROM e)) / (SELECT count(DISTINCT turn) FROM e)::DOUBLE AS episode_coverage, (SELECT string_agg(record_id, ',' ORDER BY record_id) FROM p WHERE rid % 4 = 3) AS unsupported
""")
def public_metrics(spark, sf_dir):
    """E08, of the first forty meetings' report."""
    r = records(spark, sf_dir).where("meeting_id < 40").select(F.col("record_id").alias("claim_id"), F.col("turn").alias("episode_id"), (F.col("rid") % 2 == 0).alias("mandatory"), "rid")
    out = E.public_metrics(r.where("rid % 4 <> 3"), r.where("rid % 4 <> 0").drop("mandatory"))
    return out.select("mandatory_claim_recall", "atomic_public_precision", "episode_coverage", F.array_join("unsupported_claims", ",").alias("unsupported"))


@query("""
WITH m AS (SELECT event_type, avg((value > 30)::INTEGER) AS decision_false_positive, avg((value > 1)::INTEGER) AS public_factual_precision FROM events GROUP BY 1)
SELECT event_type, concat_ws(',', CASE WHEN decision_false_positive > 0.01 THEN 'decision_false_positive' END, CASE WHEN public_factual_precision < 0.99 THEN 'public_factual_precision' END) AS failures, NOT (decision_false_positive > 0.01 OR public_factual_precision < 0.99) AS passed FROM m
""")
def release_gate(spark, sf_dir):
    """E10."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 30).cast("int")).alias("decision_false_positive"), F.avg((F.col("value") > 1).cast("int")).alias("public_factual_precision"))
    return E.release_gate(m, E.RELEASE_POLICY).select("event_type", F.array_join("failures", ",").alias("failures"), "passed")


# ---------------------------------------------------------------- files


@query("""
WITH f AS (SELECT doc_id, text, source || '.txt' AS name, sha256(text) AS d, sha256(sha256(text) || chr(0) || source || '.txt') AS fp FROM documents WHERE text IS NOT NULL)
SELECT fp AS fingerprint, min(doc_id::VARCHAR) AS path, any_value(name) AS name FROM f GROUP BY fp HAVING bool_and(doc_id % 5 <> 0)
""")
def ingested_files(spark, sf_dir):
    """Documents as files of their source's name; files equal to one whose doc_id five divides are known."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.concat("source", F.lit(".txt")).alias("name"), F.col("text").alias("content"), "doc_id")
    from .functions import scalars as S

    jobs = files.where("doc_id % 5 = 0").select(S.submission_fingerprint(F.sha2("content", 256), "name").alias("fingerprint"))
    return Z.ingest(files.drop("doc_id"), jobs).select("fingerprint", "path", "name")


@query("""
WITH f AS (SELECT doc_id, source, sha256(text) AS d FROM documents WHERE text IS NOT NULL), j AS (SELECT * FROM f WHERE doc_id % 2 = 0)
SELECT f.doc_id, min(j.doc_id) AS id FROM f JOIN j ON f.d = j.d AND (f.doc_id % 3 = 0 AND f.doc_id = j.doc_id OR f.source = j.source OR f.doc_id // 10 = j.doc_id // 10) GROUP BY 1
""")
def found_jobs(spark, sf_dir):
    """Same fingerprint (every third file), or same content with same name or path."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    cols = [F.sha2("text", 256).alias("content_sha256"), F.col("source").alias("name"), F.floor(F.col("doc_id") / 10).alias("path")]
    files = d.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("fingerprint"), *cols)
    jobs = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("fingerprint"), *cols)
    return Z.find_jobs(files, jobs).select(F.col("file_id").alias("doc_id"), "id")


@query(f"""
WITH r AS ({REC})
SELECT 'rttm' AS kind, printf('SPEAKER s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', start, "end" - start, speaker) AS value FROM r
UNION ALL SELECT 'markdown', '**' || speaker || '** [' || printf('%02d:%02d:%02d.000', floor(start / 3600)::BIGINT, floor((start % 3600) / 60)::BIGINT, (start % 60)::BIGINT) || '] ' || t FROM r
""")
def exported_lines(spark, sf_dir):
    """S11 S13."""
    r = records(spark, sf_dir)
    lines = Z.markdown_lines(r.select(F.col("record_id").alias("utterance_id"), "speaker", (F.col("start") * 1000).cast("long").alias("start_ms"), F.col("t").alias("text")))
    return Z.rttm_lines(r, "s").select(F.lit("rttm").alias("kind"), "value").unionByName(lines.select(F.lit("markdown").alias("kind"), "value"))
