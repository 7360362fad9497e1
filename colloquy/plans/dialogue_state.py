"""Meeting state: events of records, what relates them over the whole meeting, and what of them is still alive.

records: meeting_id, record_id, kind, statement, topic, start, subject, predicate, object, polarity, speech_act, revision_cue,
quantities (array of value, unit, entity, role), attributed_speakers, risks, answer_record_ids, assignment_status, question_status.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.state import cut

SCOPE_SECONDS = 180.0
SCOPE_ROWS = 3
SAME = 0.55
# fixed values: words that tell nothing about a proposition, and acts of speech acts and kinds
IGNORED = ("это", "как", "для", "что", "при", "или", "уже", "ещё", "будет", "нужно", "надо")
ACT_OF_SPEECH = {"assert": "assertion", "decide": "decision", "commit": "assignment", "ask": "question", "propose": "proposal", "correct": "correction"}
ACT_OF_KIND = {"action": "assignment", "current_state": "assertion", "observation": "assertion", "metric": "assertion", "goal": "proposal"}
ANSWERS = ("answers", "partially_answers", "tentatively_answers")


@dataclass
class MeetingState:
    events: DataFrame
    relations: DataFrame


def _look_up(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def events(records: DataFrame) -> DataFrame:
    """One event a record, numbered (n) in order of time, with its act, the tokens of its proposition and the signature of its quantities."""
    text = F.concat_ws(" ", "subject", "predicate", "object", "statement")
    act = F.coalesce(_look_up(F.col("speech_act"), ACT_OF_SPEECH), _look_up(F.col("kind"), ACT_OF_KIND), F.col("kind"), F.lit("assertion"))
    event = S.stable_id("EV", S.canonical_json({"m": "meeting_id", "r": "record_id"}))
    signature = F.array_sort(F.array_distinct(F.transform(F.coalesce("quantities", F.array()), lambda q: F.concat_ws("|", *[F.coalesce(q[x].cast("string"), F.lit("")) for x in ("value", "unit", "entity", "role")]))))
    e = records.withColumn("event_id", event).withColumn("act", act).withColumn("tokens", F.array_except(S.tokens(text), F.array(*map(F.lit, IGNORED)))).withColumn("signature", signature)
    e = e.withColumn("cue", F.coalesce("revision_cue", F.lit(False)) | F.coalesce(F.col("speech_act") == "correct", F.lit(False)))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("meeting_id").orderBy("start", "event_id")))


def revisions(ev: DataFrame) -> DataFrame:
    """A cue corrects the last event of the scope: of a speaker in common, in the last 180 seconds, of the same topic or one of the three before."""
    side = lambda p: ev.select("meeting_id", F.explode(F.array_distinct("attributed_speakers")).alias("speaker"), F.col("n").alias(f"{p}n"), F.col("event_id").alias(f"{p}event"), F.col("start").alias(f"{p}start"), F.col("topic").alias(f"{p}topic"), "cue", "speech_act")
    slot = lambda c: F.floor(F.col(c) / SCOPE_SECONDS)
    late = side("c_").where("cue").drop("speech_act").withColumn("slot", F.explode(F.array(slot("c_start"), slot("c_start") - 1)))
    old = side("o_").where(~F.coalesce(F.col("speech_act").isin("ask", "accept", "reject"), F.lit(False))).drop("cue", "speech_act").withColumn("slot", slot("o_start"))
    near = late.join(old, ["meeting_id", "speaker", "slot"]).where((F.col("o_n") < F.col("c_n")) & (F.col("c_start") - F.col("o_start") <= SCOPE_SECONDS))
    near = near.where(F.col("o_topic").eqNullSafe(F.col("c_topic")) | (F.col("c_n") - F.col("o_n") <= SCOPE_ROWS))
    last = near.groupBy("meeting_id", "c_event").agg(F.max_by("o_event", "o_n").alias("o_event"))
    return last.select("meeting_id", F.col("c_event").alias("source_event"), F.lit("corrects").alias("relation"), F.col("o_event").alias("target_event"), F.lit("explicit_revision_scope").alias("basis"))


def same_proposition(ev: DataFrame) -> DataFrame:
    """(meeting_id, a, b): pairs of events, the later one first, of one subject and predicate, or of which the one with fewer tokens shares .55 of them.

    Candidates share one of the rarest tokens of the smaller side: of k tokens it may miss .45 k, so one of the
    rarest floor(.45 k) + 1 is in the other.  Frequent tokens are in few of these, and no group is gathered.
    """
    t = ev.select("meeting_id", "n", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    rare = t.groupBy("meeting_id", "token").agg(F.count("*").alias("df"))
    t = t.join(rare, ["meeting_id", "token"])
    rank = F.row_number().over(Window.partitionBy("meeting_id", "n").orderBy("df", "token"))
    ask = t.withColumn("k", rank).where(F.col("k") <= F.floor((1 - SAME) * F.col("size") + 1e-9) + 1)
    pairs = ask.select("meeting_id", "token", F.col("n").alias("x"), F.col("size").alias("xs")).join(t.select("meeting_id", "token", F.col("n").alias("y"), F.col("size").alias("ys")), ["meeting_id", "token"]).where("x <> y and xs <= ys")
    spo = ev.where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> ''").select("meeting_id", "subject", "predicate", F.col("n").alias("x"))
    exact = spo.join(spo.withColumnRenamed("x", "y"), ["meeting_id", "subject", "predicate"]).where("x > y")
    order = lambda df, sure: df.select("meeting_id", F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), F.lit(sure).alias("sure"))
    found = order(pairs, False).unionByName(order(exact, True)).groupBy("meeting_id", "a", "b").agg(F.max("sure").alias("sure"))
    left, right = (ev.select("meeting_id", F.col("n").alias(s), F.col("tokens").alias(f"{s}t")) for s in "ab")
    j = found.join(left, ["meeting_id", "a"]).join(right, ["meeting_id", "b"])
    shared = F.size(F.array_intersect("at", "bt")) / F.greatest(F.lit(1), F.least(F.size("at"), F.size("bt")))
    return j.where(F.col("sure") | (shared >= SAME)).select("meeting_id", "a", "b")


def repeated(ev: DataFrame) -> DataFrame:
    """What a later event of the same proposition does to an earlier one."""
    columns = ("event_id", "polarity", "signature", "act", "speech_act", "cue", "revision_cue", "risks")
    one = lambda p, n: ev.select("meeting_id", F.col("n").alias(n), *[F.col(c).alias(f"{p}{c}") for c in columns])
    j = same_proposition(ev).join(one("c_", "a"), ["meeting_id", "a"]).join(one("o_", "b"), ["meeting_id", "b"])
    other = (F.col("c_signature") != F.col("o_signature")) & (F.size("c_signature") > 0) & (F.size("o_signature") > 0)
    signal = F.coalesce(F.array_contains("c_risks", "correction"), F.lit(False)) | F.coalesce("c_revision_cue", F.lit(False))
    rules = (
        ("contradicts", ~F.col("c_polarity").eqNullSafe(F.col("o_polarity")), "same_proposition_opposite_polarity"), ("supersedes", other & F.col("c_cue"), "same_proposition_quantity_changed_with_revision_cue"),
        ("conflicts_with", other, "same_proposition_quantity_changed_without_revision_cue"), ("accepts", (F.col("c_act") == "decision") & F.col("o_act").isin("proposal", "assertion"), "decision_accepts_prior_proposition"),
        ("answers", (F.col("c_speech_act") == "answer") & (F.col("o_act") == "question"), "answer_matches_question_proposition"), ("corrects", signal, "same_proposition_with_correction_signal"),
    )
    found = None
    for name, holds, basis in rules:
        pair = F.struct(F.lit(name).alias("relation"), F.lit(basis).alias("basis"))
        found = F.when(holds, pair) if found is None else found.when(holds, pair)
    return j.withColumn("_r", found).where("_r is not null").select("meeting_id", F.col("c_event_id").alias("source_event"), F.col("_r.relation").alias("relation"), F.col("o_event_id").alias("target_event"), F.col("_r.basis").alias("basis"))


def stated(ev: DataFrame) -> DataFrame:
    """Answers that questions name, and assignments that their assignee confirmed."""
    of = ev.select("meeting_id", F.col("record_id").alias("_a"), F.col("event_id").alias("source_event"))
    named = ev.select("meeting_id", F.col("event_id").alias("target_event"), F.explode(F.array_distinct("answer_record_ids")).alias("_a")).join(of, ["meeting_id", "_a"])
    answers = named.select("meeting_id", "source_event", F.lit("answers").alias("relation"), "target_event", F.lit("global_or_explicit_answer_record_link").alias("basis"))
    own = ev.where("assignment_status = 'confirmed'").select("meeting_id", F.col("event_id").alias("source_event"), F.lit("accepted_by").alias("relation"), F.col("event_id").alias("target_event"), F.lit("grounded_assignee_confirmation").alias("basis"))
    return answers.unionByName(own)


def meeting_state(records: DataFrame) -> MeetingState:
    """Events with their lifecycle, and the relations between them."""
    ev = cut(events(records))  # a dozen steps read them
    rel = revisions(ev).unionByName(repeated(ev)).unionByName(stated(ev)).distinct()
    rel = rel.withColumn("relation_id", S.stable_id("R", S.canonical_json({"b": "basis", "r": "relation", "s": "source_event", "t": "target_event"})))
    is_ = lambda *names: F.col("relation").isin(*names)
    ends = rel.select("meeting_id", F.col("target_event").alias("event_id"), is_("supersedes", "corrects").alias("s"), is_("conflicts_with").alias("c"), is_(*ANSWERS).alias("r"), "relation_id")
    ends = ends.unionByName(rel.where(is_("conflicts_with")).select("meeting_id", F.col("source_event").alias("event_id"), F.lit(False).alias("s"), F.lit(True).alias("c"), F.lit(False).alias("r"), "relation_id"))
    told = ends.groupBy("meeting_id", "event_id").agg(F.max("s").alias("_s"), F.max("c").alias("_c"), F.max("r").alias("_r"), F.count_distinct("relation_id").alias("n_relations"))
    life = F.when(F.col("_s"), "superseded").when(F.col("_c"), "conflicting").when(F.col("_r"), "resolved").otherwise("active")
    out = ev.join(told, ["meeting_id", "event_id"], "left").withColumn("lifecycle", life).withColumn("n_relations", F.coalesce("n_relations", F.lit(0).cast("long")))
    return MeetingState(out.drop("_s", "_c", "_r"), rel)


def views(state: MeetingState) -> DataFrame:
    """(meeting_id, view, event_id): decisions, tasks, questions, timeline, summary and history."""
    e, alive = state.events, F.col("lifecycle") == "active"
    shown = F.array_compact(F.array(
        F.when(alive & (F.col("act") == "decision"), "decisions"), F.when(alive & (F.col("kind") == "action"), "tasks"), F.when(F.col("act") == "question", "questions"), F.when(alive & F.col("kind").isin("rule", "task", "goal", "schedule", "metric"), "timeline"),
        F.when(alive, "summary"), F.when(~alive, "history"),
    ))
    return e.select("meeting_id", F.explode(shown).alias("view"), "event_id")
