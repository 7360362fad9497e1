"""The meeting graph: records to propositions, events, relations, states, claims and episodes, as one plan of DataFrames.

records: meeting_id, record_id, kind, statement, speaker, start, end, evidence_ids, actions (array), answers (array of record ids),
corrects (array of record ids), accepts (array of record ids).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import matching as M
from ..operators import sequence as Q
from ..operators import state as G

# fixed values: content kinds that differ from the kind itself; all others are a state
CONTENT_KINDS = ("question", "decision", "proposal", "action", "follow_up", "definition", "hypothesis", "experimental_result", "blocker", "risk", "metric", "schedule", "goal", "system_rule", "trading_rule")
REPLY_SECONDS = 45.0
REPLY_WORDS = 10
RELATION_SECONDS = 120.0
RELATION_ROWS = 8


@dataclass
class MeetingGraph:
    records: DataFrame
    propositions: DataFrame
    events: DataFrame
    relations: DataFrame
    decisions: DataFrame
    claims: DataFrame
    episodes: DataFrame


def content_kind(kind: Column) -> Column:
    return F.when(kind.isin(*CONTENT_KINDS), kind).otherwise("state")


def expand_actions(records: DataFrame) -> DataFrame:
    """Each action clause becomes a record of its own with its parent's lineage; parents stay unless they are actions themselves."""
    base = records.withColumn("parent_id", F.lit(None).cast("string"))
    parents = base.where((F.coalesce(F.size("actions"), F.lit(0)) <= 0) | (F.col("kind") != "action"))
    children = base.select("*", F.posexplode("actions").alias("_k", "_a")).withColumn("parent_id", F.col("record_id")).withColumn("record_id", F.format_string("%s.%d", F.col("record_id"), F.col("_k") + 1)).withColumn("statement", F.col("_a")).withColumn("kind", F.lit("action")).drop("_k", "_a")
    return parents.unionByName(children.select(*parents.columns))


def expand_replies(records: DataFrame, turns: DataFrame, gap: str = "\\s+") -> DataFrame:
    """Short replies of another speaker right after a record's last turn become records of their own, the first record of a turn has it.

    turns: meeting_id, turn_id, speaker, text, start, end.  ``gap``: what parts the words of a reply that are counted.
    """
    w = Window.partitionBy("meeting_id").orderBy("start", "turn_id")
    t = turns.withColumn("_prior", F.lag("turn_id").over(w)).withColumn("_who", F.lag("speaker").over(w)).withColumn("_until", F.lag("end").over(w))
    short = t.where((F.col("speaker") != F.col("_who")) & (F.col("start") - F.col("_until") <= REPLY_SECONDS) & (F.size(F.split(F.trim("text"), gap)) <= REPLY_WORDS))
    act = S.primary_speech_act("text")
    short = short.withColumn("_act", act).where(F.col("_act").isin("accept", "reject", "answer"))
    spread = records.select("meeting_id", "record_id", "start", F.explode("evidence_ids").alias("_prior"))
    hit = short.select("meeting_id", "turn_id", "speaker", "text", F.col("start").alias("_s"), F.col("end").alias("_e"), "_prior", "_act").join(spread, ["meeting_id", "_prior"])
    first = hit.groupBy("meeting_id", "turn_id").agg(F.min_by(F.struct("record_id", "speaker", "text", "_s", "_e", "_act"), F.struct("start", "record_id")).alias("r")).select("meeting_id", "turn_id", "r.*")
    covered = records.select("meeting_id", F.explode("evidence_ids").alias("turn_id")).distinct()
    new = first.join(covered, ["meeting_id", "turn_id"], "left_anti")
    none = F.array().cast("array<string>")
    made = new.select(
        "meeting_id", F.concat(F.lit("reply-"), F.col("turn_id")).alias("record_id"), F.col("_act").alias("kind"), F.col("text").alias("statement"), "speaker", F.col("_s").alias("start"), F.col("_e").alias("end"), F.array("turn_id").alias("evidence_ids"),
        none.alias("actions"), F.when(F.col("_act") == "answer", F.array("record_id")).otherwise(none).alias("answers"), none.alias("corrects"), F.when(F.col("_act") == "accept", F.array("record_id")).otherwise(none).alias("accepts"),
    )
    return records.unionByName(made.select(*records.columns))


def propositions(records: DataFrame) -> DataFrame:
    """Records with their proposition: a hash of the folded statement, kind of content and polarity."""
    negative = S.fold("statement").rlike("(?iuU)(?:^|\\W)(?:не|нет|нельзя|никогда|без|not|no|never)(?:\\W|$)")
    r = records.withColumn("content_kind", content_kind(F.col("kind"))).withColumn("polarity", F.when(negative, "negative").otherwise("positive"))
    signature = S.canonical_json({"content": "content_kind", "polarity": "polarity", "statement": S.squeezed("statement")})
    return r.withColumn("proposition_id", S.stable_id("P", signature))


def events(records: DataFrame) -> DataFrame:
    r = records.withColumn("act", S.primary_speech_act("statement", "kind"))
    return r.select("meeting_id", "record_id", "proposition_id", "content_kind", "act", "speaker", "start", "end", "statement", S.stable_id("EV", S.canonical_json({"p": "proposition_id", "r": "record_id"})).alias("event_id"))


def relations(records: DataFrame, ev: DataFrame) -> DataFrame:
    """Explicit links first; else the latest of the eight events before, within 120 seconds, that the act refers to."""
    of = ev.select("meeting_id", "record_id", "event_id", "proposition_id")
    links = []
    for column, kind in (("answers", "answers"), ("corrects", "corrects"), ("accepts", "accepts")):
        links.append(records.select("meeting_id", "record_id", F.explode(column).alias("_to"), F.lit(kind).alias("type")))
    said = links[0].unionByName(links[1]).unionByName(links[2])
    target = of.select("meeting_id", F.col("record_id").alias("_to"), F.col("proposition_id").alias("target_claim_id"))
    explicit = said.join(of, ["meeting_id", "record_id"]).join(target, ["meeting_id", "_to"]).select("meeting_id", "event_id", "type", F.col("proposition_id").alias("source_claim_id"), "target_claim_id")
    past = M.look_back(ev, ["meeting_id"], ["start", "event_id"], RELATION_ROWS, ["event_id", "act", "proposition_id", "statement", "start", "content_kind"])
    near = past.where((F.col("start") - F.col("p_start") <= RELATION_SECONDS) & (F.col("proposition_id") != F.col("p_proposition_id")))
    alike = S.similarity("statement", "p_statement")
    kind = (
        F.when((F.col("act") == "correct") & (alike >= 0.2), "corrects").when((F.col("act") == "accept") & F.col("p_act").isin("propose", "decide", "commit") & (F.col("start") - F.col("p_start") <= REPLY_SECONDS), "accepts")
        .when((F.col("act") == "reject") & F.col("p_act").isin("propose", "decide", "commit") & (F.col("start") - F.col("p_start") <= REPLY_SECONDS), "rejects").when((F.col("act") == "answer") & (F.col("p_act") == "ask"), "answers")
    )
    implied = M.top_per(near.withColumn("type", kind).where("type is not null"), ["meeting_id", "event_id"], [F.col("distance"), F.col("p_event_id")], 1)
    implied = implied.join(explicit.select("meeting_id", "event_id"), ["meeting_id", "event_id"], "left_anti").select("meeting_id", "event_id", "type", F.col("proposition_id").alias("source_claim_id"), F.col("p_proposition_id").alias("target_claim_id"))
    both = explicit.unionByName(implied).where("source_claim_id <> target_claim_id").distinct()
    ids = S.stable_id("R", S.canonical_json({"e": "event_id", "s": "source_claim_id", "t": "target_claim_id", "type": "type"}))
    return both.withColumn("relation_id", ids).withColumn("evidence_ids", F.array("event_id"))


def build(records: DataFrame, turns: DataFrame | None = None) -> MeetingGraph:
    r = expand_actions(records).drop("parent_id")
    if turns is not None:
        r = expand_replies(r, turns)
    r = propositions(r)
    ev = events(r)
    rel = relations(r, ev)
    p = r.groupBy("meeting_id", "proposition_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("statement", F.struct("start", "record_id")).alias("statement"), F.first("content_kind").alias("content_kind"),
        F.array_sort(F.collect_set("speaker")).alias("speakers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
    )
    when = ev.select("meeting_id", "event_id", "start", "speaker")
    moves = rel.where(F.col("type").isin("accepts", "rejects", "corrects", "supersedes")).join(when, ["meeting_id", "event_id"]).select(F.col("target_claim_id").alias("proposition_id"), "type", F.col("start").alias("at"), "event_id", F.col("speaker").alias("actor"))
    decided = ev.where("act = 'decide'").select("proposition_id", F.lit("decides").alias("type"), F.col("start").alias("at"), "event_id", F.col("speaker").alias("actor"))
    decisions = G.reduce_decisions(p.where(F.col("content_kind").isin("decision", "proposal")), moves.unionByName(decided))
    claims = G.reconcile_lifecycle(p.withColumn("claim_id", F.col("proposition_id")), rel)
    rows = claims.select("meeting_id", "claim_id", "start", "end", "statement", F.col("speakers").alias("entities"), F.col("content_kind").alias("kind"), F.lit(False).alias("cue"), F.lit(0.0).alias("shift"))
    episodes = Q.fold(rows, ["meeting_id"], ["start", "claim_id"], Q.Episodes, "claim_id string, episode int")
    return MeetingGraph(r, p, ev, rel, decisions, claims, episodes)
