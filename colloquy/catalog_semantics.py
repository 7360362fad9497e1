"""Queries of semantic records, timelines and merges: facts of three turns each, over the conversations' own texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog_records import REC, ident, records
from .catalog_text import TOKENS, acts_sql, first_act_sql, matches
from .functions import markup as M
from .functions import scalars as S
from .operators import dialogue as D
from .operators import edits as E
from .operators import facts as X
from .operators import graph as R
from .operators import publication as P
from .operators import semantics as N
from .operators import sequence as Q
from .operators import timeline as T
from .plans import dialogue_state as Y
from .registry import WORDS, query, table, words
from .sources import formats as Z

# RE2 has no look-ahead: the onset of work, without the rule that no other person comes in between
PROGRESS = N.PROGRESS.replace(r"(?:(?!\b(?:он|она|они|ты|вы)\b)[^.!?\n])", r"[^.!?\n]")
MODEL_ACTS = ("commit", "ask", "answer", None)


def semantic_facts(spark, sf_dir):
    """Every turn as a fact whose evidence are it and the two after it; what a model says of it is made of its numbers and ids."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    ids = F.array(*[ident("R", rid + k) for k in range(3)])
    number = F.coalesce(F.nullif(F.regexp_extract("o", r"\d+(?:[.,]\d+)?", 0), F.lit("")), F.lit("3"))
    own = F.array(F.col("record_id"))
    raw = F.struct(
        ids.alias("confirmation_evidence_ids"), F.array(F.lit("nobody"), F.lit("assistant"), F.lit("user")).alias("proposed_by"),
        F.array(F.struct(F.when(rid % 2 == 0, F.concat(F.lit("если "), "o")).otherwise(F.col("o")).alias("predicate"), F.lit(None).cast("string").alias("effect"), own.alias("evidence_ids"))).alias("conditions"),
        F.array(F.struct(number.alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("string").alias("metric_status"), ids.alias("evidence_ids"))).alias("quantities"),
        F.when(rid % 3 == 0, "unresolved").alias("question_status"), F.when(rid % 4 == 0, F.array(ident("R", rid + 1), F.lit("R-1"))).alias("answer_evidence_ids"), F.array(F.concat(F.lit("F"), rid), F.lit("x")).alias("answer_record_ids"),
        F.get(F.array(*map(F.lit, MODEL_ACTS)), F.pmod(rid, F.lit(4)).cast("int")).alias("speech_act"), F.when(rid % 6 == 0, "после 00:00").alias("time_expression"), F.lit(None).cast("string").alias("timezone"),
    )
    names = [f.split(":", 1)[0] for f in ("modality", "content_kind", "predicate", "object", "polarity")]
    for n in names:
        raw = raw.withField(n, F.lit(None).cast("string"))
    raw = raw.withField("requested_slots", F.array(F.lit("time"), F.lit(" "), F.lit("time"))).withField("answered_slots", F.lit(None).cast("array<string>"))
    raw = raw.withField("actions", F.array(F.struct(F.lit("a").alias("action_id"), F.lit("user").alias("actor"), F.lit("prepare_report").alias("predicate"), F.lit("отчёт до пятницы").alias("object"), F.lit("client").alias("recipient"), F.lit("completed").alias("temporal_state"), F.lit("explicit_commitment").alias("commitment_state"), F.lit(False).alias("parallel"), own.alias("evidence_ids"))))
    facts = r.select(
        "meeting_id", F.col("record_id").alias("fact_id"), F.col("kind").alias("type"), F.lit(None).cast("string").alias("topic"), F.col("t").alias("statement"), F.lit(None).cast("string").alias("certainty"), "start", ids.alias("evidence_ids"),
        F.when(rid % 5 == 0, F.array(F.lit("assistant"))).otherwise(F.array().cast("array<string>")).alias("owner_refs"), F.array("speaker").alias("speaker_refs"), F.array().cast("array<string>").alias("entities"), F.lit("supported").alias("verification_status"), raw.alias("raw"),
    )
    turns = r.select("meeting_id", F.col("record_id").alias("id"), "speaker", F.col("t").alias("text"), "start")
    return N.with_evidence(facts, turns, ["meeting_id"])


KNOWN = f"""
WITH r AS ({REC}),
e AS (SELECT a.record_id AS f, list(struct_pack(id := b.record_id, speaker := b.speaker, text := b.t) ORDER BY b.start) AS ev FROM r AS a JOIN r AS b ON a.meeting_id = b.meeting_id AND b.rid BETWEEN a.rid AND a.rid + 2 GROUP BY 1),
w AS (SELECT r.*, ev, list_distinct(list_transform(ev, lambda x: x.speaker)) AS people, {matches("t", S.COMMITMENT)} AS promised,
  list_distinct(list_transform(list_filter(ev, lambda x: {matches("x.text", N.PROMISE)} OR {matches("x.text", N.OWN_TASK)} OR {matches("x.text", PROGRESS)} OR {matches("x.text", N.PAST)}), lambda x: x.speaker)) AS hands,
  list_distinct(list_transform(list_filter(ev, lambda x: {matches("x.text", PROGRESS)} OR {matches("x.text", N.PAST)}), lambda x: x.speaker)) AS working FROM r JOIN e ON r.record_id = e.f),
o AS (SELECT *, kind = 'action' OR promised AS work, CASE WHEN rid % 5 = 0 AND list_contains(people, 'assistant') AND (kind = 'action' OR promised OR len(working) = 1) THEN ['assistant'] WHEN kind = 'action' OR promised THEN CASE WHEN len(hands) = 1 THEN hands ELSE []::VARCHAR[] END
  WHEN len(working) = 1 THEN working ELSE []::VARCHAR[] END AS owners FROM w),
p AS (SELECT *, CASE WHEN work THEN list_transform(list_filter(ev, lambda x: list_contains(owners, x.speaker)), lambda x: x.id) ELSE ['R' || rid, 'R' || (rid + 1), 'R' || (rid + 2)] END AS confirmed,
  CASE WHEN len(owners) = 1 THEN array_to_string(list_transform(list_filter(ev, lambda x: x.speaker = owners[1]), lambda x: x.text), ' ') ELSE '' END AS own,
  array_to_string(list_transform(ev, lambda x: x.text), ' ') AS heard, coalesce(nullif(regexp_extract(o, '[0-9]+(?:[.,][0-9]+)?'), ''), '3') AS amount FROM o),
a AS (SELECT *, {matches("own", N.PROMISE)} AS promise, {first_act_sql(acts_sql("t"))} AS said FROM p),
b AS (SELECT *, CASE WHEN promise THEN 'commit' WHEN said = 'commit' THEN CASE WHEN kind IN ('action', 'proposal') THEN 'propose' ELSE 'assert' END ELSE said END AS act0 FROM a),
c AS (SELECT *, CASE WHEN act0 <> 'assert' THEN act0 WHEN kind = 'question' THEN 'ask' WHEN kind = 'proposal' THEN 'propose' WHEN kind = 'decision' THEN 'decide' ELSE 'assert' END AS act1 FROM b),
d AS (SELECT *, CASE WHEN act1 = 'assert' AND (rid % 4 IN (1, 2) OR (rid % 4 = 0 AND promised)) THEN CASE rid % 4 WHEN 0 THEN 'commit' WHEN 1 THEN 'ask' ELSE 'answer' END ELSE act1 END AS act2 FROM c),
z AS (SELECT *, CASE WHEN kind = 'action' AND len(owners) = 1 AND act2 IN ('assert', 'answer', 'ask', 'commit') AND len(list_filter(ev, lambda x: x.speaker = owners[1] AND contains(x.text, '?') AND ({matches("x.text", N.OWN_TASK)} OR {matches("x.text", r"(?iuU)\b" + N.VERBS + r"\b")}))) > 0
  THEN 'propose' ELSE act2 END AS act FROM d)
"""


@query(f"""{KNOWN}
SELECT record_id, array_to_string(owners, ',') AS assignees, CASE WHEN NOT (work OR len(working) = 1) THEN 'not_applicable' WHEN len(owners) > 0 AND len(confirmed) > 0 THEN 'confirmed' WHEN len(owners) > 0 THEN 'unconfirmed' ELSE 'unknown' END AS assignment_status,
  array_to_string(confirmed, ',') AS confirmations, CASE WHEN kind IN ('proposal', 'action') THEN array_to_string(list_filter(['assistant', 'user'], lambda x: list_contains(people, x)), ',') ELSE '' END AS proposed_by,
  CASE WHEN rid % 2 = 0 OR {matches("o", N.CONDITION)} THEN 1 ELSE 0 END AS n_conditions,
  CASE WHEN len(list_filter(regexp_extract_all(heard, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')::DOUBLE = replace(amount, ',', '.')::DOUBLE)) > 0 THEN amount || ':' || CASE
    WHEN replace(amount, ',', '.')::DOUBLE BETWEEN 1900 AND 2100 AND {matches("heard", N.YEARS)} THEN 'calendar_year' WHEN {matches("heard", N.DIMENSIONS["timeframe"])} THEN 'timeframe' WHEN {matches("heard", N.DIMENSIONS["duration"])} THEN 'duration' WHEN {matches("heard", N.DIMENSIONS["percentage"])} THEN 'percentage' ELSE 'count' END ELSE '' END AS quantities,
  CASE WHEN kind <> 'question' THEN 'not_applicable' WHEN rid % 4 = 0 THEN 'resolved' WHEN rid % 3 = 0 OR {matches("t", N.UNRESOLVED)} THEN 'unresolved' WHEN {matches("t", N.RESOLVED)} THEN 'resolved' ELSE 'unclear' END AS question_status,
  act AS speech_act, CASE WHEN promise AND len(owners) = 1 THEN 'explicit' WHEN act = 'commit' THEN 'implicit' ELSE 'none' END AS commitment_strength, {matches("heard", S.CORRECTION)} AS revision_cue,
  CASE WHEN rid % 6 = 0 THEN 'ambiguous_clock' ELSE 'not_provided' END AS time_status, CASE WHEN rid % 6 = 0 AND kind = 'action' THEN 'insufficient_evidence' ELSE 'supported' END AS verification_status
FROM z
""")
def semantic_records(spark, sf_dir):
    """P22."""
    n = N.normalize_records(semantic_facts(spark, sf_dir))
    line = lambda c: F.array_join(c, ",")
    amounts = F.transform("quantities", lambda q: F.concat_ws(":", q["amount"], q["dimension"]))
    return n.select(
        "record_id", line("assignees").alias("assignees"), "assignment_status", line("confirmation_evidence_ids").alias("confirmations"), line("proposed_by").alias("proposed_by"), F.size("conditions").alias("n_conditions"), line(amounts).alias("quantities"),
        "question_status", "speech_act", "commitment_strength", "revision_cue", "time_status", "verification_status",
    )


# ---------------------------------------------------------------- timelines


def voice_segments(spark, sf_dir):
    """Turns a second apart, as long as their text; the verifier hears the speaker before in every third length."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    before = F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.col("role"))
    c = c.withColumn("p", F.array("role")).withColumn("v", F.array(F.when(F.col("n") % 3 == 0, before).otherwise(F.col("role"))))
    start = F.col("turn").cast("double")
    return c.select(
        "conv_id", F.col("turn").alias("pos"), start.alias("start"), (start + F.greatest(F.lit(0.1), F.least(F.lit(2.4), F.round(F.col("n") / 300, 3)))).alias("end"), F.col("p").alias("primary"), F.col("v").alias("verifier_mapped"),
        F.array_sort(F.array_union("p", "v")).alias("candidates"), F.col("p").alias("clusters"), F.when(F.array_contains("v", F.col("role")), 1.0).otherwise(0.0).alias("agreement"), (F.col("n") % 7 == 0).alias("overlap"), "n",
    )


VOICES = """
WITH RECURSIVE c AS (SELECT conv_id, turn, role AS p, length(text) AS n, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), role) AS before FROM conversations),
s AS (SELECT conv_id, turn, turn::DOUBLE AS start, turn::DOUBLE + greatest(0.1::DOUBLE, least(2.4::DOUBLE, round(n / 300, 3))) AS "end", p, CASE WHEN n % 3 = 0 THEN before ELSE p END AS v, n % 7 = 0 AS overlap, n % 11 = 0 AS loc, n FROM c),
m AS (SELECT DISTINCT conv_id, x AS cluster, CASE WHEN x = 'user' OR (x = 'assistant' AND conv_id % 5 = 0) THEN 'P1' WHEN x = 'assistant' AND conv_id % 2 = 0 THEN 'P2' END AS profile FROM (SELECT conv_id, unnest([p, v]) AS x FROM s)),
a AS (SELECT conv_id, x AS cluster, min(turn * 10 + CASE WHEN x = least(p, v) THEN 0 ELSE 1 END) AS met FROM (SELECT *, unnest([p, v]) AS x FROM s) GROUP BY ALL),
w AS (SELECT m.conv_id, m.cluster, profile IS NOT NULL AS known, CASE WHEN profile IS NOT NULL THEN 'profile:' || profile ELSE 'UNKNOWN_' || row_number() OVER (PARTITION BY m.conv_id, profile IS NULL ORDER BY met) END AS id,
  CASE profile WHEN 'P1' THEN 0.9::DOUBLE WHEN 'P2' THEN 0.6::DOUBLE ELSE 0::DOUBLE END AS score, CASE profile WHEN 'P1' THEN 0.3::DOUBLE WHEN 'P2' THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS margin FROM m JOIN a USING (conv_id, cluster)),
d AS (SELECT s.*, a.id AS pi, b.id AS vi, a.known AS pk, b.known AS vk,
  CASE WHEN loc THEN 'redimnet_second_pass' WHEN p = v THEN 'diarizers_agree' WHEN a.known AND b.known AND a.id = b.id THEN 'voice_id_resolved_same_person' WHEN a.known AND NOT b.known THEN 'voice_id_primary' WHEN b.known AND NOT a.known THEN 'voice_id_verifier'
    WHEN "end" - start <= 1.5 AND a.known AND b.known THEN 'short_turn_verifier' ELSE 'primary_low_confidence' END AS decision
  FROM s JOIN w AS a ON a.conv_id = s.conv_id AND a.cluster = p JOIN w AS b ON b.conv_id = s.conv_id AND b.cluster = v),
e AS (SELECT d.*, CASE WHEN loc THEN CASE WHEN pi = 'profile:P1' AND (p <= v OR vi <> 'profile:P1') THEN p WHEN vi = 'profile:P1' THEN v ELSE 'local:P1' END WHEN decision = 'voice_id_resolved_same_person' THEN least(p, v) WHEN decision IN ('voice_id_verifier', 'short_turn_verifier') THEN v ELSE p END AS cluster FROM d),
g AS (SELECT e.conv_id, turn, start, "end", p, v, overlap, decision, e.cluster, coalesce(w.id, 'profile:P1') AS id, coalesce(w.known, true) AS known, coalesce(w.score, 0.8::DOUBLE) AS score, coalesce(w.margin, 0.1::DOUBLE) AS margin FROM e LEFT JOIN w ON w.conv_id = e.conv_id AND w.cluster = e.cluster),
h AS (SELECT *, CASE WHEN decision = 'primary_low_confidence' THEN 0.58::DOUBLE WHEN known AND p = v THEN least(0.99::DOUBLE, 0.70::DOUBLE + 0.20::DOUBLE * score + 0.09::DOUBLE * least(1, margin / 0.2::DOUBLE)) WHEN known THEN least(0.89::DOUBLE, 0.58::DOUBLE + 0.22::DOUBLE * score + 0.07::DOUBLE * least(1, margin / 0.2::DOUBLE))
  WHEN p = v THEN 0.72::DOUBLE ELSE 0.45::DOUBLE END AS c FROM g),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start, "end", id, turn) AS k, start, "end", p, v, overlap, decision, cluster, id, known, round(c, 4) AS c, CASE WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS lv FROM h),
f AS (SELECT a.conv_id, a.k, arg_min(struct_pack(p := b.p, v := b.v, overlap := b.overlap, id := b.id, known := b.known), b.k) AS nx FROM o AS a JOIN o AS b ON a.conv_id = b.conv_id AND b.k > a.k AND b.start >= a."end" - 1e-6 GROUP BY ALL),
t AS (
  SELECT conv_id, 0::BIGINT AS k, list_filter([struct_pack(start := 0::DOUBLE, "end" := 0::DOUBLE, p := '', v := '', overlap := false, decision := '', cluster := '', id := '', known := false, c := 0::DOUBLE, lv := '')], lambda x: x.id = 'none') AS done FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL
  SELECT conv_id, k, list_append(done, CASE WHEN tid IS NULL THEN struct_pack(start := start, "end" := "end", p := p, v := v, overlap := overlap, decision := decision, cluster := cluster, id := id, known := known, c := c, lv := lv)
    ELSE struct_pack(start := start, "end" := "end", p := p, v := v, overlap := overlap, decision := 'short_turn_context', cluster := cluster, id := tid, known := true, c := 0.74::DOUBLE, lv := 'MEDIUM') END)
  FROM (SELECT *, CASE WHEN overlap OR "end" - start > 1.5 OR (known AND lv <> 'LOW') THEN NULL WHEN tp AND tn AND pv.id = nx.id THEN pv.id WHEN tp AND NOT tn THEN pv.id WHEN tn AND NOT tp THEN nx.id WHEN np AND nn AND pv.id = nx.id THEN pv.id END AS tid
    FROM (SELECT *, np AND (pv.p = p OR pv.v = v) AS tp, nn AND (nx.p = p OR nx.v = v) AS tn
      FROM (SELECT *, coalesce(pv.known AND NOT pv.overlap, false) AS np, coalesce(nx.known AND NOT nx.overlap, false) AS nn
        FROM (SELECT o.*, t.done, f.nx, list_filter(t.done, lambda x: x."end" <= o.start + 1e-6)[-1] AS pv FROM t JOIN o ON o.conv_id = t.conv_id AND o.k = t.k + 1 LEFT JOIN f ON f.conv_id = o.conv_id AND f.k = o.k)))) AS z
), r AS (SELECT conv_id, unnest(arg_max(done, k)) AS x, unnest(range(1, max(k) + 1)) AS k FROM t GROUP BY conv_id HAVING max(k) > 0),
j AS (
  SELECT conv_id, k, x, x."end" AS upto, 1 AS run FROM r WHERE k = 1
  UNION ALL SELECT r.conv_id, r.k, r.x, CASE WHEN same THEN greatest(j.upto, r.x."end") ELSE r.x."end" END, j.run + CASE WHEN same THEN 0 ELSE 1 END
  FROM j JOIN r ON r.conv_id = j.conv_id AND r.k = j.k + 1, LATERAL (SELECT r.x.id = j.x.id AND r.x.overlap = j.x.overlap AND r.x.start - j.upto <= 0.3 AS same)
)
SELECT conv_id, min(x.start) AS start, max(x."end") AS "end", any_value(x.id) AS speaker_id, min(x.c) AS confidence, arg_min(x.decision, k) AS decision, any_value(x.overlap) AS overlap, array_to_string(list_sort(list_distinct(list(x.cluster))), '+') AS clusters, count(*)::INTEGER AS n_segments FROM j GROUP BY conv_id, run
"""


@query(VOICES)
def resolved_timeline(spark, sf_dir):
    """W22."""
    s = voice_segments(spark, sf_dir)
    names = s.select("conv_id", F.explode("candidates").alias("cluster")).distinct()
    first = (F.col("cluster") == "user") | ((F.col("cluster") == "assistant") & (F.col("conv_id") % 5 == 0))
    second = (F.col("cluster") == "assistant") & (F.col("conv_id") % 2 == 0)
    matches = names.withColumn("profile_id", F.when(first, "P1").when(second, "P2")).where("profile_id is not null").withColumn("name", F.col("profile_id")).withColumn("score", F.when(F.col("profile_id") == "P1", 0.9).otherwise(0.6)).withColumn("margin", F.when(F.col("profile_id") == "P1", 0.3).otherwise(0.05)).withColumn("session_prototype", F.lit(False))
    local = s.where("n % 11 = 0").select("conv_id", "pos", F.lit("P1").alias("profile_id"), F.lit("P1").alias("name"), F.lit(0.8).alias("score"), F.lit(0.1).alias("margin"))
    out = T.resolve(s, matches, ["conv_id"], local)
    return out.select("conv_id", "start", "end", "speaker_id", "confidence", "decision", "overlap", F.array_join("clusters", "+").alias("clusters"), "n_segments")


# ---------------------------------------------------------------- meeting state


def state_records(spark, sf_dir):
    """Turns as records: their numbers are their quantities, a question names the two records after it."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0))))
    quantity = lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("role"))
    nothing = F.lit(None).cast("string")
    return r.select(
        "meeting_id", "record_id", "kind", F.col("t").alias("statement"), (rid % 2).cast("string").alias("topic"), "start", F.when(rid % 9 == 0, F.col("speaker")).alias("subject"), F.when(rid % 9 == 0, F.lit("says")).alias("predicate"), nothing.alias("object"),
        F.when(S.fold("t").rlike(X.NEGATION), "negative").otherwise("positive").alias("polarity"), S.primary_speech_act("t", "kind").alias("speech_act"), F.col("t").rlike(S.CORRECTION).alias("revision_cue"), F.transform(numbers, quantity).alias("quantities"),
        F.array("speaker").alias("attributed_speakers"), F.array().cast("array<string>").alias("risks"), F.when(F.col("kind") == "question", F.array(ident("R", rid + 1), ident("R", rid + 2), ident("R", rid + 1))).alias("answer_record_ids"),
        F.when(rid % 5 == 0, "confirmed").alias("assignment_status"), nothing.alias("question_status"),
    )


ACT_CASE = "CASE said " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Y.ACT_OF_SPEECH.items()) + " ELSE CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Y.ACT_OF_KIND.items()) + " ELSE kind END END"
STATE = f"""
WITH a AS (SELECT *, {first_act_sql(acts_sql("t"))} AS act0 FROM ({REC})),
r AS (SELECT *, CASE WHEN act0 <> 'assert' THEN act0 ELSE CASE kind WHEN 'question' THEN 'ask' WHEN 'decision' THEN 'decide' WHEN 'proposal' THEN 'propose' WHEN 'action' THEN 'commit' ELSE 'assert' END END AS said,
  {matches("t", S.CORRECTION)} AS cue, {matches("t", X.NEGATION)} AS negative, list_sort(list_distinct(regexp_extract_all(t, '[0-9]+'))) AS q, CASE WHEN rid % 9 = 0 THEN speaker || ' says' END AS spo FROM a),
e AS (SELECT *, {ACT_CASE} AS act, list_filter({TOKENS.format("concat_ws(' ', spo, t)")}, lambda x: NOT list_contains({list(Y.IGNORED)}, x)) AS w, 'EV' || substr(sha256('{{"m":' || meeting_id || ',"r":"' || record_id || '"}}'), 1, 16) AS event_id FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start, event_id) AS n FROM e),
p AS (SELECT c.*, b.event_id AS b_event, b.n AS bn, b.start AS bs, b.act AS b_act, b.negative AS b_neg, b.q AS bq, b.rid AS b_rid, b.said AS b_said, b.speaker AS b_speaker,
  coalesce(c.spo = b.spo, false) OR len(list_intersect(c.w, b.w)) / greatest(1, least(len(c.w), len(b.w)))::DOUBLE >= 0.55 AS same FROM o AS c JOIN o AS b ON c.meeting_id = b.meeting_id AND b.n < c.n),
z AS (SELECT event_id, 'corrects' AS relation, arg_max(b_event, bn) AS target, 'explicit_revision_scope' AS basis FROM p WHERE (cue OR said = 'correct') AND speaker = b_speaker AND start - bs <= 180 AND b_said NOT IN ('ask', 'accept', 'reject') AND (rid % 2 = b_rid % 2 OR n - bn <= 3) GROUP BY event_id),
s AS (SELECT event_id, b_event AS target, CASE WHEN negative <> b_neg THEN 'contradicts' WHEN q <> bq AND len(q) > 0 AND len(bq) > 0 THEN CASE WHEN cue OR said = 'correct' THEN 'supersedes' ELSE 'conflicts_with' END WHEN act = 'decision' AND b_act IN ('proposal', 'assertion') THEN 'accepts'
  WHEN said = 'answer' AND b_act = 'question' THEN 'answers' WHEN cue THEN 'corrects' END AS relation FROM p WHERE same),
x AS (SELECT b.event_id, 'answers' AS relation, a.event_id AS target, 'global_or_explicit_answer_record_link' AS basis FROM o AS a JOIN o AS b ON a.kind = 'question' AND a.meeting_id = b.meeting_id AND b.rid IN (a.rid + 1, a.rid + 2)
  UNION ALL SELECT event_id, 'accepted_by', event_id, 'grounded_assignee_confirmation' FROM o WHERE rid % 5 = 0),
l AS (SELECT * FROM z UNION SELECT event_id, relation, target, CASE relation WHEN 'contradicts' THEN 'same_proposition_opposite_polarity' WHEN 'supersedes' THEN 'same_proposition_quantity_changed_with_revision_cue' WHEN 'conflicts_with' THEN 'same_proposition_quantity_changed_without_revision_cue'
  WHEN 'accepts' THEN 'decision_accepts_prior_proposition' WHEN 'answers' THEN 'answer_matches_question_proposition' ELSE 'same_proposition_with_correction_signal' END FROM s WHERE relation IS NOT NULL UNION SELECT * FROM x)
"""


@query(f"{STATE} SELECT event_id AS source_event, relation, target AS target_event, basis FROM l")
def state_relations(spark, sf_dir):
    """G09."""
    return Y.meeting_state(state_records(spark, sf_dir)).relations.select("source_event", "relation", "target_event", "basis")


@query(f"""{STATE}, t AS (
  SELECT target AS event_id, relation IN ('supersedes', 'corrects') AS s, relation = 'conflicts_with' AS c, relation = 'answers' AS r FROM l UNION ALL SELECT event_id, false, true, false FROM l WHERE relation = 'conflicts_with'),
g AS (SELECT event_id, bool_or(s) AS s, bool_or(c) AS c, bool_or(r) AS r FROM t GROUP BY 1),
v AS (SELECT o.*, CASE WHEN s THEN 'superseded' WHEN c THEN 'conflicting' WHEN r THEN 'resolved' ELSE 'active' END AS lifecycle FROM o LEFT JOIN g USING (event_id))
SELECT meeting_id, view, event_id, lifecycle FROM (SELECT *, unnest(list_filter([CASE WHEN lifecycle = 'active' AND act = 'decision' THEN 'decisions' END, CASE WHEN lifecycle = 'active' AND kind = 'action' THEN 'tasks' END, CASE WHEN act = 'question' THEN 'questions' END,
  CASE WHEN lifecycle = 'active' THEN 'summary' ELSE 'history' END], lambda y: y IS NOT NULL)) AS view FROM v)
""")
def state_views(spark, sf_dir):
    """Each view's events with their lifecycle."""
    state = Y.meeting_state(state_records(spark, sf_dir))
    return Y.views(state).join(state.events.select("event_id", "lifecycle"), "event_id").select("meeting_id", "view", "event_id", "lifecycle")


# ---------------------------------------------------------------- edits


@query("""
WITH RECURSIVE e AS (
  SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN turn - 1 ELSE (turn + 1) // 2 END AS expected, role AS field, left(text, 12) AS value, CASE WHEN turn % 6 = 5 THEN ' ' ELSE role END AS actor, row_number() OVER (PARTITION BY conv_id ORDER BY -(turn % 2), turn) AS k FROM conversations
), t AS (
  SELECT conv_id, 0::BIGINT AS k, -1::BIGINT AS turn, '' AS outcome, 0::BIGINT AS revision, [struct_pack(f := '', v := '')] AS patch FROM (SELECT DISTINCT conv_id FROM e WHERE conv_id % 10 <> 0)
  UNION ALL
  SELECT conv_id, k, turn, outcome, revision + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END, CASE WHEN outcome = 'applied' THEN list_append(list_filter(patch, lambda x: x.f <> field), struct_pack(f := field, v := value)) ELSE patch END
  FROM (SELECT e.*, t.revision, t.patch, CASE WHEN actor = ' ' THEN 'invalid' WHEN expected <> t.revision THEN 'revision_conflict' WHEN list_contains(patch, struct_pack(f := field, v := value)) THEN 'unchanged' ELSE 'applied' END AS outcome
    FROM t JOIN e ON e.conv_id = t.conv_id AND e.k = t.k + 1)
)
SELECT conv_id, turn, outcome, revision, array_to_string(list_sort(list_transform(list_filter(patch, lambda x: x.f <> ''), lambda x: x.f || '=' || x.v)), ';') AS patch FROM t WHERE k > 0
UNION ALL SELECT conv_id, turn, 'unknown', NULL, NULL FROM e WHERE conv_id % 10 = 0
""")
def revised_tasks(spark, sf_dir):
    """A conversation's turns edit one object, odd ones first; every tenth object doesn't exist."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("long")
    expected = F.when(turn % 4 == 3, turn - 1).otherwise(F.floor((turn + 1) / 2))
    edits = c.select("conv_id", turn.alias("edit_id"), expected.alias("expected_revision"), F.create_map("role", F.substring("text", 1, 12)).alias("changes"), F.when(turn % 6 == 5, " ").otherwise(F.col("role")).alias("actor"), (-(turn % 2)).alias("edited_at"))
    current = c.select("conv_id").distinct().where("conv_id % 10 <> 0").select("conv_id", F.lit(0).alias("revision"), F.create_map().cast("map<string,string>").alias("patch"))
    out = E.compare_and_swap(current, edits, ["conv_id"])
    patch = F.array_join(F.array_sort(F.transform(F.map_entries("patch"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return out.select("conv_id", F.col("edit_id").alias("turn"), "outcome", "revision", patch.alias("patch"))


@query("""
WITH w AS (SELECT conv_id, turn, string_split_regex(trim(text), '\\s+') AS w, len(text) AS n FROM conversations),
s AS (SELECT conv_id, turn, w, n, array_to_string(w, ' ') AS base, CASE WHEN n % 3 = 0 THEN 'FIRST' ELSE 'Other' END AS other FROM w)
SELECT conv_id, turn, CASE WHEN len(w) < 4 THEN base WHEN n % 3 = 1 THEN NULL ELSE array_to_string(list_concat(['FIRST'], w[2:len(w) - 1], ['LAST', 'more']), ' ') END AS merged FROM s
""")
def merged_texts(spark, sf_dir):
    """copies of each turn, one with another first word, one with another end; the third one's first word agrees, or differs in every third length."""
    c = table(spark, sf_dir, "conversations").withColumn("w", F.split(F.trim("text"), "\\s+")).withColumn("n", F.length("text"))
    line = lambda a: F.array_join(a, " ")
    k = F.size("w")
    first = lambda x: line(F.concat(F.array(F.lit(x)), F.slice("w", 2, F.greatest(F.lit(0), k - 1))))
    last = line(F.concat(F.slice("w", 1, F.greatest(F.lit(0), k - 1)), F.array(F.lit("LAST"), F.lit("more"))))
    third = F.when(F.col("n") % 3 == 1, first("Other")).when(F.col("n") % 3 == 0, first("FIRST"))
    copies = F.when(k < 4, F.array().cast("array<string>")).otherwise(F.array(first("FIRST"), last, third))
    return c.select("conv_id", "turn", E.merge_texts(line("w"), copies).alias("merged"))


@query("""
SELECT event_id, '{"audio_sha256": "' || event_type || '", "command": ["run", "--api-token", "[REDACTED]", "' || event_type || '"], "n": ' || event_id || ', "nested": {"refresh_tokens": "[REDACTED]", "tokens": ' || user_id || '}, "source_text": "[REDACTED]", "utterance": "[REDACTED]"}' AS safe FROM events
""")
def redacted_logs(spark, sf_dir):
    """events as log lines with texts, tokens and a command line."""
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(
        F.col("event_id").alias("n"), F.col("props").alias("utterance"), F.array(F.lit("run"), F.lit("--api-token"), F.col("props"), F.col("event_type")).alias("command"), F.col("event_type").alias("audio_sha256"), F.coalesce("props", F.lit("")).alias("source_text"),
        F.struct(F.array("props").alias("refresh_tokens"), F.col("user_id").alias("tokens")).alias("nested"),
    ))
    return e.select("event_id", D.redact_json(line).alias("safe"))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def escaped(c: F.Column) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query(f"""
SELECT conv_id, turn, '<div><p>' || {ESCAPED.format("text")} || '</p><a>x</a><a href="https://e.org/?a=1&amp;b=2">l</a><br>' || CASE turn % 2 WHEN 0 THEN '<details class="editor-details-block" data-id="transcript-' || md5(conv_id::VARCHAR) || '"><summary class="editor-details-summary">s</summary></details>' ELSE '<details><summary class="editor-details-summary">s</summary></details>' END || '</div>' AS safe
FROM conversations
""")
def safe_markup(spark, sf_dir):
    """turns as HTML with handlers, scripts, links of several kinds and blocks."""
    c = table(spark, sf_dir, "conversations")
    block = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("transcript-"), F.md5(F.col("conv_id").cast("string")))).otherwise("other")
    html = F.concat(F.lit('<div class="x" onclick="a()"><p style="color:red">'), escaped(F.col("text")), F.lit('</p><script>bad("</p>")</script><a href="javascript:x()">x</a><iframe><p>in</p></iframe><a href="https://e.org/?a=1&b=2" target=_top>l</a><img src=x><br/><details data-id="'), block, F.lit('"><summary>s</summary></details></div>'))
    once = M.safe_html(html)
    return c.select("conv_id", "turn", M.safe_html(once).alias("safe"))


@query(f"""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' ELSE '<h1>Meeting other</h1>' END || '<p>' || {ESCAPED.format("text")} || '</p>' || CASE turn % 2 WHEN 0 THEN '' ELSE '<p>between</p><ul><li>0:01</li></ul>' END || '<h2>Notes</h2><ul><li>kept</li></ul>' AS cleaned FROM conversations
""")
def cleaned_summaries(spark, sf_dir):
    """documents with a title, participants and timecodes; edits of them stay."""
    c = table(spark, sf_dir, "conversations")
    title = F.concat(F.lit("Meeting "), F.col("conv_id"))
    html = F.concat(
        F.lit("<h1>"), F.when(F.col("turn") % 3 == 0, title).otherwise("Meeting other"), F.lit("</h1><p><strong>Participants:</strong> Ann</p><p>"), escaped(F.col("text")), F.lit("</p><h2>Timecodes</h2>"),
        F.when(F.col("turn") % 2 == 0, "").otherwise("<p>between</p>"), F.lit('<ul><li>0:01</li></ul><attachment-component src="a1"></attachment-component><h2>Notes</h2><ul><li>kept</li></ul>'),
    )
    return c.select("conv_id", "turn", M.clean_summary(html, title, "Participants:", "Timecodes", ["a1"]).alias("cleaned"))


@query(f"""
WITH RECURSIVE w AS (SELECT conv_id, pos, start, "end" + CASE WHEN pos % 17 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS e, CASE WHEN pos * 7 % 5 < 2 THEN NULL WHEN pos * 13 % 11 < 5 THEN 'a' ELSE 'b' END AS who FROM ({WORDS})),
n AS (SELECT *, row_number() OVER o AS k, first_value(CASE WHEN who IS NOT NULL THEN struct_pack(s := start, who := who) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
t AS (
  SELECT conv_id, 0::BIGINT AS k, -1::BIGINT AS pos, NULL::VARCHAR AS speaker, false AS inferred, NULL::DOUBLE AS pe, NULL::VARCHAR AS pw FROM (SELECT DISTINCT conv_id FROM n)
  UNION ALL
  SELECT conv_id, k, pos, found, who IS NULL AND found IS NOT NULL, CASE WHEN found IS NOT NULL THEN e ELSE pe END, coalesce(found, pw)
  FROM (SELECT *, CASE WHEN who IS NOT NULL THEN who WHEN e - start > 0.35 OR least(coalesce(dp, 9e9), coalesce(dn, 9e9)) > 0.4 THEN NULL WHEN dp IS NULL THEN nx.who WHEN dn IS NULL THEN pw WHEN pw = nx.who THEN pw WHEN dp + 0.12 < dn THEN pw WHEN dn + 0.12 < dp THEN nx.who END AS found
    FROM (SELECT n.*, t.pe, t.pw, CASE WHEN pw IS NOT NULL THEN greatest(0::DOUBLE, n.start - t.pe) END AS dp, CASE WHEN nx IS NOT NULL THEN greatest(0::DOUBLE, nx.s - n.e) END AS dn FROM t JOIN n ON n.conv_id = t.conv_id AND n.k = t.k + 1))
)
SELECT conv_id, pos, speaker, inferred FROM t WHERE k > 0
""")
def filled_speakers(spark, sf_dir):
    """J02, second phase: two words of five without a speaker, every seventeenth longer."""
    w = words(spark, sf_dir)
    who = F.when(F.col("pos") * 7 % 5 < 2, None).when(F.col("pos") * 13 % 11 < 5, "a").otherwise("b")
    w = w.select("conv_id", "pos", "start", (F.col("end") + F.when(F.col("pos") % 17 == 0, 0.1).otherwise(0.0)).alias("end"), who.alias("speaker"))
    return Q.fill_from_neighbours(w, ["conv_id"], "pos", ["pos"], "speaker").select("conv_id", "pos", "speaker", "inferred")


@query(f"""
WITH RECURSIVE a AS (SELECT *, {first_act_sql(acts_sql("t"))} AS said, rid % 5 + 2 AS n FROM ({REC})),
p AS (SELECT *, n || CASE WHEN n < 5 THEN ' недели' ELSE ' недель' END AS value, said IN ('assert', 'answer', 'decide') AS asserted, rid % 4 = 0 AS accepted, rid % 3 = 0 AS fixed FROM a),
v AS (SELECT k.rid AS task, r.rid, r.value, r.asserted, r.accepted, r.fixed, row_number() OVER (PARTITION BY k.rid ORDER BY r.start, 'S' || r.rid) AS k FROM p AS k JOIN p AS r ON k.kind = 'action' AND r.meeting_id = k.meeting_id AND r.rid > k.rid AND r.rid - k.rid <= 6),
t AS (
  SELECT rid AS task, 0::BIGINT AS k, CASE WHEN rid % 2 = 0 THEN '1 месяц' END AS scope, rid % 2 = 0 AS sure, '' AS old, '' AS proposed, '' AS rel FROM p WHERE kind = 'action'
  UNION ALL
  SELECT task, k, CASE WHEN holds THEN value ELSE scope END, CASE WHEN holds THEN accepted OR asserted ELSE sure END, old || CASE WHEN holds AND scope <> value THEN scope || ';' ELSE '' END, proposed || CASE WHEN holds THEN '' ELSE value || ';' END, rel || CASE WHEN holds THEN 'S' || rid || ';' ELSE '' END
  FROM (SELECT v.*, t.scope, t.sure, t.old, t.proposed, t.rel, accepted OR (asserted AND NOT fixed) OR scope IS NULL AS holds FROM t JOIN v ON v.task = t.task AND v.k = t.k + 1)
)
SELECT 'R' || task AS task_id, arg_max(coalesce(scope, ''), k) AS current_scope, arg_max(sure, k) AS confirmed, arg_max(old, k) AS superseded, arg_max(proposed, k) AS proposed, arg_max(rel, k) AS relations FROM t GROUP BY task
""")
def task_scopes(spark, sf_dir):
    """G02, scopes: the six turns after an action revise it to some weeks."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    props = r.select("meeting_id", F.col("record_id").alias("proposition_id"), F.concat((rid % 5 + 2).cast("string"), F.lit(" недель. "), "t").alias("statement"), F.when(rid % 3 == 0, "constraint").otherwise("x").alias("content_kind"))
    events = r.select("meeting_id", F.col("record_id").alias("proposition_id"), S.primary_speech_act("t").alias("speech_act"), "start")
    turns = F.array().cast("array<struct<id:string,speaker:string,text:string,start:double>>")
    tasks = r.where("kind = 'action'").select("meeting_id", F.col("record_id").alias("task_id"), F.when(rid % 2 == 0, "1 месяц").alias("scope"), F.col("speaker").alias("owner"), turns.alias("turns"))
    ahead = r.where("kind = 'action'").select("meeting_id", F.col("record_id").alias("target_id"), F.explode(F.array(*[rid + k for k in range(1, 7)])).alias("rid"))
    revises = ahead.join(r.select("meeting_id", "rid"), ["meeting_id", "rid"]).select("meeting_id", F.concat(F.lit("S"), "rid").alias("relation_id"), F.lit("revises_scope").alias("type"), ident("R", rid).alias("source_id"), "target_id", F.array(F.lit("e")).alias("evidence_ids"))
    accepts = r.where("rid % 4 = 0").select("meeting_id", F.concat(F.lit("A"), "rid").alias("relation_id"), F.lit("accepts").alias("type"), F.lit("x").alias("source_id"), F.col("record_id").alias("target_id"), F.array(F.lit("e")).alias("evidence_ids"))
    out = R.scope_history(tasks, props, revises.unionByName(accepts), events, ["meeting_id"])
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x, F.lit(";"))), "")
    values = lambda c: line(F.transform(c, lambda x: x["value"]))
    return out.select("task_id", F.coalesce("current_scope", F.lit("")).alias("current_scope"), "confirmed", values("scope_history").alias("superseded"), values("proposed_scopes").alias("proposed"), line("relation_ids").alias("relations"))


@query(f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start, record_id) AS k FROM ({REC}) WHERE rid % 3 <> 0), a AS (SELECT * FROM ({REC})),
l AS (SELECT meeting_id, 'L' || rid AS id, rid AS s, rid + 1 AS t FROM a WHERE rid % 2 = 0 UNION ALL SELECT meeting_id, 'M' || rid, rid, rid + 3 FROM a WHERE rid % 5 = 0),
e AS (SELECT meeting_id, id, s AS c, t AS o FROM l UNION ALL SELECT meeting_id, id, t, s FROM l),
n AS (SELECT r.meeting_id, r.rid, r.k, r.kind, list(struct_pack(id := e.id, o := e.o, ok := m.rid IS NOT NULL) ORDER BY e.id) FILTER (e.id IS NOT NULL) AS links FROM r LEFT JOIN e ON e.meeting_id = r.meeting_id AND e.c = r.rid LEFT JOIN r AS m ON m.meeting_id = r.meeting_id AND m.rid = e.o GROUP BY ALL),
u AS (SELECT *, list_filter(links, lambda x: x.ok)[1:3] AS used FROM n),
t AS (
  SELECT meeting_id, 0::BIGINT AS k, 0::BIGINT AS unit, NULL::BIGINT AS rid, []::BIGINT[] AS done, false AS made, ''::VARCHAR AS ids, ''::VARCHAR AS rel, ''::VARCHAR AS loose, '' AS role FROM u WHERE k = 1
  UNION ALL
  SELECT meeting_id, k, unit + (NOT held)::INTEGER, rid, CASE WHEN held THEN done ELSE list_concat(done, list_concat([rid], coalesce(list_transform(used, lambda x: x.o), []))) END, NOT held,
    array_to_string(list_concat(['R' || rid], coalesce(list_transform(used, lambda x: 'R' || x.o), [])), ','), coalesce(array_to_string(list_transform(used, lambda x: x.id), ','), ''),
    coalesce(array_to_string(list_filter(list_transform(links, lambda x: x.id), lambda y: NOT list_contains(list_transform(used, lambda x: x.id), y)), ','), ''), CASE WHEN kind = 'decision' THEN 'state_change' ELSE 'technical_context' END
  FROM (SELECT u.*, t.unit, t.done, list_contains(t.done, u.rid) AS held FROM t JOIN u ON u.meeting_id = t.meeting_id AND u.k = t.k + 1)
)
SELECT meeting_id, printf('SU%04d', unit) AS unit_id, 'R' || rid AS central_claim_id, ids AS claim_ids, rel AS relation_ids, loose AS unresolved_edges, role FROM t WHERE made
""")
def summary_units(spark, sf_dir):
    """T09, units: two of three turns are chosen; even ones are related to the next, every fifth to the third after it."""
    r = records(spark, sf_dir)
    rid = F.col("rid")
    link = lambda letter, far: [F.col("meeting_id"), F.concat(F.lit(letter), rid).alias("relation_id"), F.col("record_id").alias("source_claim_id"), ident("R", rid + far).alias("target_claim_id")]
    relations = r.where("rid % 2 = 0").select(*link("L", 1)).unionByName(r.where("rid % 5 = 0").select(*link("M", 3)))
    chosen = r.where("rid % 3 <> 0").select("meeting_id", F.lit("minutes").alias("view"), F.col("record_id").alias("claim_id"), "start", (F.col("kind") == "decision").alias("mandatory"))
    u = P.summary_units(chosen, relations, ["meeting_id"])
    line = lambda c: F.array_join(c, ",").alias(c)
    return u.select("meeting_id", "unit_id", "central_claim_id", line("claim_ids"), line("relation_ids"), line("unresolved_edges"), "role")


@query("""
SELECT conv_id, 'Meeting ' || conv_id AS title, role AS section, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place, replace(text, 'a', '[\\') AS text, CASE WHEN turn % 2 = 0 THEN 't' || turn END AS target FROM conversations
""")
def parsed_documents(spark, sf_dir):
    """Conversations as Markdown documents and back, whole texts with brackets and backslashes among them."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.replace("text", F.lit("a"), F.lit("[\\")))
    items = c.select("conv_id", F.col("role").alias("section"), F.col("role").alias("section_place"), F.col("turn").alias("place"), "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), "turn")).alias("target"))
    return Z.parse_documents(Z.render_documents(items, ["conv_id"], F.concat(F.lit("Meeting "), "conv_id")), ["conv_id"])


@query("""
WITH r AS (SELECT *, conv_id * 1000 + turn AS rid FROM conversations)
SELECT 'missing item' AS kind, 'R' || rid AS id FROM r WHERE rid % 7 = 0 UNION ALL SELECT 'changed text', 'R' || rid FROM r WHERE rid % 7 <> 0 AND rid % 5 = 0 UNION ALL SELECT 'dead link', 'R' || rid FROM r WHERE rid % 7 <> 0 AND rid % 11 = 0
UNION ALL SELECT 'unknown item', 'new' FROM (SELECT min(rid) AS m FROM r WHERE rid % 7 <> 0) WHERE m IS NOT NULL
""")
def checked_documents(spark, sf_dir):
    """Published documents against their items, both ways, from the text alone: every seventh is left out, every fifth changed, every eleventh links to nothing, one line has no item."""
    c = table(spark, sf_dir, "conversations").withColumn("rid", F.col("conv_id") * 1000 + F.col("turn"))
    shown = c.where("rid % 7 <> 0")
    text = F.when(F.col("rid") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    target = F.concat(F.when(F.col("rid") % 11 == 0, "none").otherwise("R"), F.col("rid"))
    items = shown.select("conv_id", F.lit("s").alias("section"), F.lit(0).alias("section_place"), F.col("turn").alias("place"), F.concat(F.lit("R"), "rid", F.lit(" "), text).alias("text"), target.alias("target"))
    first = shown.agg(F.min_by("conv_id", "rid").alias("conv_id")).where("conv_id is not null")
    more = first.select("conv_id", F.lit("t").alias("section"), F.lit(1).alias("section_place"), F.lit(0).alias("place"), F.lit("new line").alias("text"), F.lit(None).cast("string").alias("target"))
    lines = Z.parse_documents(Z.render_documents(items.unionByName(more), ["conv_id"], F.lit("title")), ["conv_id"])
    key = F.substring_index("text", " ", 1)
    lines = lines.select(key.alias("line_id"), key.alias("item_key"), F.expr("substring(text, length(substring_index(text, ' ', 1)) + 2)").alias("text"), "target")
    return P.document_faults(lines, c.select(F.concat(F.lit("R"), "rid").alias("item_key"), "text"), c.select(F.concat(F.lit("R"), "rid").alias("target"))).where("kind <> 'poor label'")
