"""The meeting graph's reducers: tasks, questions, rules, experiments, resolutions and commitments, as joins and first-match rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .dialogue import duration_scope
from .sequence import Fold, fold



def none() -> Column:
    return F.array().cast("array<string>")

# fixed values: what a question may be resolved to, and what stays open
RESOLVED = ("answered", "partially_answered", "tentatively_answered")
QUESTION_STATES = (*RESOLVED, "unanswered", "deferred", "requires_external_verification", "rhetorical", "superseded")
UPSTREAM = ("deferred", "requires_external_verification", "rhetorical", "superseded")
# fixed values: who asks whether the work is theirs, and what confirms it
OWNER_QUESTION = r"(?iuU)\bмне\s+(?:\w+\s+){0,4}(?:сделать|подготовить|разметить|проверить|отправить)\b"
CONFIRMED = r"(?iuU)^\s*(?:да|ага|верно|правильно|договорились|сделай|нужно)\b"
SENSITIVE_KINDS = ("decision", "action", "schedule", "metric")


def first_rule(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    out = F
    for condition, value in rules:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def compute_plan(level: Column, kind: Column) -> Column:
    """struct(tier, passes, fail_closed): how much checking the risk of a record asks for."""
    critical = (level == "CRITICAL") | ((level == "HIGH") & kind.isin(*SENSITIVE_KINDS))
    tier = first_rule([(critical, "CRITICAL"), (level == "HIGH", "HIGH"), (level == "MEDIUM", "MEDIUM")], "LOW")
    passes = {
        "CRITICAL": ("deterministic", "independent_verifier", "audio_repair", "speaker_recheck"), "HIGH": ("deterministic", "independent_verifier", "expanded_context"),
        "MEDIUM": ("deterministic", "verifier"), "LOW": ("deterministic",),
    }
    table = F.create_map(*[x for k, v in passes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.struct(tier.alias("tier"), F.element_at(table, tier).alias("passes"), tier.isin("CRITICAL", "HIGH").alias("fail_closed"))


def family(fields: dict[str, str], statement: str) -> Column:
    """The lineage key of a claim: a hash of its signature's fields, or of its folded text where all are empty."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in fields.values()]
    none = empty[0]
    for e in empty[1:]:
        none = none & e
    words = F.trim(F.regexp_replace(S.fold(statement), "(?U)\\s+", " "))
    return S.stable_id("LIN", F.when(none, F.to_json(F.struct(words.alias("fallback")))).otherwise(S.canonical_json(dict(fields))))


def task_records(records: DataFrame) -> DataFrame:
    """Action records as tasks, with whether they may run by themselves: confirmed and certain."""
    unsure = F.coalesce("needs_review", F.lit(False))
    sure = (F.col("assignment_status") == "confirmed") & ~unsure
    return records.where("kind = 'action'").select(
        F.concat(F.lit("T"), F.expr("substring(record_id, 2)")).alias("task_id"), "record_id", "statement", "start", F.coalesce(sure, F.lit(False)).alias("automation_eligible"),
        F.when(sure, "eligible").when(unsure, "unknown").otherwise("human_only").alias("automation_status"),
    )


def reduce_tasks(candidates: DataFrame, transitions: DataFrame) -> DataFrame:
    """Status of every task candidate: the first state that its record supports, then what later moves made of it.

    candidates: task_id, owners (array), completed, self_proposed, confirmed, intends, temporal_state, blocked, commitment_state,
    explicit, actor, assignment_status, third_person, speech_act, speakers (how many may have said it).
    transitions: task_id, type (accepts, confirms, accepts_assignment, rejects, corrects, supersedes), at, event_id.
    """
    owned = F.size("owners") > 0
    one = (F.size("owners") == 1) & (F.col("speakers") == 1)
    by_owner = one & (F.col("actor") == F.get("owners", F.lit(0)))
    state = first_rule([
        (F.col("completed") | (F.col("temporal_state") == "completed"), "completed"), (owned & (F.col("self_proposed") | (F.col("confirmed") & F.col("assignment_status").isin("confirmed", "accepted"))), "accepted"), (F.col("intends") & one, "intent_to_attempt"),
        (F.col("temporal_state") == "in_progress", "in_progress"), (F.col("temporal_state") == "past_attempt", "past_attempt"), (F.col("blocked"), "blocked"), ((F.col("commitment_state") == "intent_to_attempt") & by_owner, "intent_to_attempt"),
        (F.col("explicit") & by_owner, "self_committed"), (owned & F.col("assignment_status").isin("confirmed", "accepted", "assigned"), "assigned"), (owned & F.col("third_person"), "proposed"), (owned, "assigned_pending"), (F.col("speech_act") == "propose", "proposed"),
    ], "idea")
    moves = transitions.groupBy("task_id").agg(F.max_by("type", F.when(~F.col("type").isin("corrects", "supersedes"), F.struct("at", "event_id"))).alias("_last"), F.bool_or(F.col("type").isin("corrects", "supersedes")).alias("_over"))
    out = candidates.join(moves, "task_id", "left")
    status = F.when(F.col("_over"), "superseded").when(F.col("_last") == "rejects", "cancelled").otherwise(state)
    human = status.isin("idea", "proposed", "assigned", "assigned_pending", "superseded", "past_attempt", "intent_to_attempt")
    return out.select(*candidates.columns, status.alias("status"), F.when(human, "human_only").otherwise("unknown").alias("automation_status"))


ASSERTING = ("assert", "answer", "decide")
SCOPES = "array<struct<value:string,status:string,relation_id:string>>"


def scope_history(tasks: DataFrame, propositions: DataFrame, relations: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each task's scope after all revisions of it, and how it came about: current_scope, confirmed, scope_history, proposed_scopes, relation_ids, evidence_ids.

    Revisions are taken in order of time.  One holds if it is accepted (by a relation, or by the owner's own later turn that
    names its unit), if it asserts and is no constraint, or if there is no scope yet; the scope before it goes into the history.
    Others stay proposals.

    tasks: keys, task_id, scope, owner, turns (array of id, speaker, text, start); propositions: keys, proposition_id, statement, content_kind;
    relations: keys, relation_id, type, source_id, target_id, evidence_ids; events: keys, proposition_id, speech_act, start.
    """
    told = events.groupBy(*keys, "proposition_id").agg(F.max("start").alias("at"), F.min("start").alias("since"), F.bool_or(F.col("speech_act").isin(*ASSERTING)).alias("asserted"))
    yes = relations.where(F.col("type").isin("accepts", "confirms")).select(*keys, F.col("target_id").alias("proposition_id"), F.lit(True).alias("accepted")).distinct()
    source = propositions.select(*keys, "proposition_id", duration_scope(F.col("statement")).alias("value"), "content_kind").where("value is not null").join(told, [*keys, "proposition_id"], "left").join(yes, [*keys, "proposition_id"], "left")
    rev = relations.where("type = 'revises_scope'").select(*keys, "relation_id", F.col("source_id").alias("proposition_id"), F.col("target_id").alias("task_id"), "evidence_ids").join(source, [*keys, "proposition_id"])
    rev = rev.join(tasks.select(*keys, "task_id", "owner", "turns"), [*keys, "task_id"])
    unit = F.lower(F.substring(F.element_at(F.split("value", " "), -1), 1, 5))
    own = F.transform(F.filter("turns", lambda t: (t["speaker"] == F.col("owner")) & (t["start"] >= F.coalesce("since", F.lit(0.0))) & F.contains(S.fold(t["text"]), unit) & t["text"].rlike(S.ACCEPT)), lambda t: t["id"])
    rev = rev.withColumn("own", F.coalesce(own, F.array().cast("array<string>"))).withColumn("accepted", F.coalesce("accepted", F.lit(False)) | (F.size("own") > 0)).withColumn("asserted", F.coalesce("asserted", F.lit(False)))
    row = F.struct(F.coalesce("at", F.lit(0.0)).alias("at"), "relation_id", "value", "accepted", "asserted", F.coalesce(F.col("content_kind") == "constraint", F.lit(False)).alias("constraint"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), "own")
    per = rev.groupBy(*keys, "task_id").agg(F.array_sort(F.collect_list(row)).alias("_r"))  # revisions of one task
    none, scopes = F.array().cast("array<string>"), F.array().cast(SCOPES)
    start = F.struct(F.col("scope").alias("scope"), F.col("scope").isNotNull().alias("confirmed"), scopes.alias("history"), scopes.alias("proposed"), none.alias("relations"), none.alias("evidence"))

    def step(a: Column, r: Column) -> Column:
        holds = r["accepted"] | (r["asserted"] & ~r["constraint"]) | a["scope"].isNull()
        entry = lambda value, status: F.array(F.struct(value.alias("value"), F.lit(status).alias("status"), r["relation_id"].alias("relation_id")))
        grow = lambda old, when, new: F.when(when, F.concat(old, new)).otherwise(old)
        return F.struct(
            F.when(holds, r["value"]).otherwise(a["scope"]).alias("scope"), F.when(holds, r["accepted"] | r["asserted"]).otherwise(a["confirmed"]).alias("confirmed"),
            grow(a["history"], holds & (a["scope"] != r["value"]), entry(a["scope"], "superseded")).alias("history"), grow(a["proposed"], ~holds, entry(r["value"], "proposed_not_accepted")).alias("proposed"),
            grow(a["relations"], holds, F.array(r["relation_id"])).alias("relations"), F.concat(grow(a["evidence"], F.size(r["own"]) > 0, r["own"]), F.when(holds, r["evidence_ids"]).otherwise(none)).alias("evidence"),
        )

    out = tasks.join(per, [*keys, "task_id"], "left").withColumn("_s", F.aggregate(F.coalesce("_r", F.array()), start, step))
    return out.select(
        *keys, "task_id", F.col("_s.scope").alias("current_scope"), F.col("_s.confirmed").alias("confirmed"), F.when(F.col("_s.confirmed"), "accepted").when(F.col("_s.scope").isNotNull(), "proposed").otherwise("unknown").alias("scope_confidence"),
        F.col("_s.history").alias("scope_history"), F.col("_s.proposed").alias("proposed_scopes"), F.col("_s.relations").alias("relation_ids"), F.array_distinct("_s.evidence").alias("evidence_ids"),
    )


class Envelopes(Fold):
    """Rows in order of start: one joins the envelope that is open until ``span`` after the first of it, or opens the next."""

    def __init__(self, span: float = 120.0) -> None:
        self.span, self.n, self.first = span, -1, None

    def row(self, r: dict) -> Iterable[dict]:
        if self.first is None or r["start"] - self.first > self.span:
            self.n, self.first = self.n + 1, r["start"]
        return ({"task_id": r["task_id"], "envelope": self.n},)


def task_envelopes(tasks: DataFrame, keys: Sequence[str], span: float = 120.0) -> DataFrame:
    """Tasks of one owner and one piece of work within ``span``: keys (owner and work among them), envelope, the status that counts, all ids.

    tasks: task_id, start, status.  Of the statuses that tell a result the last counts, else the first of all.
    """
    told = F.col("status").isin("cancelled", "superseded", "accepted", "self_committed", "intent_to_attempt", "in_progress", "past_attempt", "completed")
    placed = fold(tasks.select(*keys, "task_id", "start"), keys, ["start", "task_id"], lambda: Envelopes(span), f"task_id {tasks.schema['task_id'].dataType.simpleString()}, envelope int")
    order = F.struct("start", "task_id")
    t = tasks.join(placed, [*keys, "task_id"])
    return t.groupBy(*keys, "envelope").agg(
        F.coalesce(F.max_by("status", F.when(told, order)), F.min_by("status", order)).alias("status"), F.min("start").alias("start"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["task_id"]).alias("task_ids"),
    )


def reduce_questions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Status of every question from the slots that its answers entail: question_id, status, answered_slots, missing_slots, remaining.

    questions: question_id, statement, requested (array), explicit (array of slots answered by statement), upstream, retrieval.
    answers: question_id, answer_id, link (answers, tentatively_answers, record, turn), entailed (array), verdict.
    """
    related = F.col("link") == "answers"
    per = answers.groupBy("question_id").agg(
        F.array_distinct(F.flatten(F.collect_list("entailed"))).alias("_slots"), F.bool_or(related).alias("_related"), F.bool_or(F.col("link") == "tentatively_answers").alias("_maybe"),
        F.bool_or(related | (F.col("link") == "record") | ((F.col("link") == "turn") & (F.size("entailed") > 0))).alias("_support"), F.bool_or(F.col("verdict") == "contradicted").alias("_against"),
    )
    q = questions.join(per, "question_id", "left")
    known = F.array_union(F.coalesce("explicit", none()), F.coalesce("_slots", none()))
    asked = F.coalesce("requested", none())
    q = q.withColumn("answered_slots", F.array_intersect(asked, known)).withColumn("missing_slots", F.array_except(asked, known))
    yes = lambda c: F.coalesce(c, F.lit(False))
    support, some = yes(F.col("_support")), F.size("answered_slots") > 0
    upstream = S.fold("upstream")
    status = first_rule([
        ((F.size(asked) > 0) & (F.size("missing_slots") == 0) & support, "answered"), (upstream.isin("answered", "resolved") & (F.size(asked) == 0) & support, "answered"),
        (((upstream == "partially_answered") & support | yes(F.col("_related"))) & some, "partially_answered"), (yes(F.col("_maybe")), "tentatively_answered"),
    ], "")
    rest = first_rule([(yes(F.col("_against")), "ambiguous_answer"), (support, "answer_not_verified"), (yes(F.col("retrieval").isin("failed", "unavailable")), "answer_retrieval_failed")], "unanswered")
    status = F.when(status != "", status).when(upstream.isin(*UPSTREAM), upstream).otherwise(rest)
    q = q.withColumn("status", status)
    closed = F.col("status").isin("answered", "tentatively_answered", "rhetorical", "superseded")
    return q.select("question_id", "status", "answered_slots", "missing_slots", F.when(~closed, F.col("statement")).alias("remaining"))


def without_wrappers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Open questions marked as mere announcements go as superseded once the question they announce is closed.

    questions: question_id, status, wrapper; answers: question_id, answer_id (the announced question).
    """
    closed = questions.where(F.col("status").isin("answered", "rhetorical", "superseded")).select(F.col("question_id").alias("answer_id"))
    done = answers.join(closed, "answer_id", "left_semi").select("question_id").distinct().withColumn("_done", F.lit(True))
    open_ = F.col("wrapper") & F.col("status").isin("unanswered", "answer_not_verified", "ambiguous_answer") & F.coalesce("_done", F.lit(False))
    return questions.join(done, "question_id", "left").withColumn("status", F.when(open_, "superseded").otherwise(F.col("status"))).drop("_done")


def rules(propositions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rules with the status of their decision: rule_id, proposition_id, status.  decisions: proposition_id, status."""
    r = propositions.where(F.col("content_kind").isin("trading_rule", "system_rule")).join(decisions.select("proposition_id", "status"), "proposition_id", "left")
    return r.select(F.concat(F.lit("RUL"), F.expr("substring(proposition_id, 2)")).alias("rule_id"), "proposition_id", F.coalesce("status", F.lit("described_existing_rule")).alias("status"))


def experiments(propositions: DataFrame, relations: DataFrame) -> DataFrame:
    """Hypotheses and results with the tests and objections that touch them: experiment_id, status, relation_ids (tests first)."""
    ends = relations.where(F.col("type").isin("tests", "contradicts", "rejects")).select("relation_id", (F.col("type") == "tests").alias("test"), F.explode(F.array_distinct(F.array("source_proposition_id", "target_proposition_id"))).alias("proposition_id"))
    per = ends.groupBy("proposition_id").agg(F.bool_or("test").alias("_tested"), F.transform(F.array_sort(F.collect_list(F.struct((~F.col("test")).alias("o"), "relation_id"))), lambda x: x["relation_id"]).alias("relation_ids"))
    e = propositions.where(F.col("content_kind").isin("hypothesis", "experimental_result")).join(per, "proposition_id", "left")
    status = first_rule([(F.col("content_kind") == "experimental_result", "result"), (F.coalesce("_tested", F.lit(False)), "test_defined")], "proposed_not_run")
    return e.select(F.concat(F.lit("EXP"), F.expr("substring(proposition_id, 2)")).alias("experiment_id"), status.alias("status"), F.coalesce("relation_ids", none()).alias("relation_ids"))


def apply_resolutions(records: DataFrame, resolutions: DataFrame, turns: DataFrame, within: float = 60.0) -> DataFrame:
    """Resolutions of questions that what was said afterwards carries: question_id, status, answer_ids, evidence_ids, confidence; the last one counts.

    records: record_id, kind, start, evidence_ids; resolutions: seq, question_id, status, answer_ids, evidence_ids, confidence; turns: turn_id, start.
    An answer has to begin no earlier than its question and, if turns are cited, share one or lie ``within`` seconds of one.
    """
    q = records.where("kind = 'question'").select(F.col("record_id").alias("question_id"), F.col("start").alias("_q"))
    r = resolutions.where(F.col("status").isin(*QUESTION_STATES)).join(q, "question_id")
    spans = r.select("seq", "_q", F.explode(F.array_distinct("evidence_ids")).alias("turn_id")).join(turns.select("turn_id", F.col("start").alias("_s")), "turn_id").where("_s >= _q")
    cited = spans.groupBy("seq").agg(F.array_sort(F.collect_list("turn_id")).alias("_spans"), F.collect_list("_s").alias("_starts"))
    found = r.select("seq", "question_id", "_q", F.explode(F.array_distinct("answer_ids")).alias("record_id")).join(records.select("record_id", F.col("start").alias("_a"), "evidence_ids"), "record_id")
    found = found.where((F.col("record_id") != F.col("question_id")) & (F.col("_a") >= F.col("_q"))).join(cited, "seq", "left")
    close = F.arrays_overlap(F.coalesce("evidence_ids", none()), F.col("_spans")) | F.exists("_starts", lambda s: F.abs(s - F.col("_a")) <= within)
    answers = found.where(F.col("_spans").isNull() | close).groupBy("seq").agg(F.array_sort(F.collect_list("record_id")).alias("_answers"))
    j = r.join(cited, "seq", "left").join(answers, "seq", "left").where(~F.col("status").isin(*RESOLVED) | F.col("_answers").isNotNull() | F.col("_spans").isNotNull())
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    row = F.struct("status", F.coalesce("_answers", none()).alias("answer_ids"), F.coalesce("_spans", none()).alias("evidence_ids"), sure.alias("confidence"))
    return j.groupBy("question_id").agg(F.max_by(row, "seq").alias("_r")).select("question_id", "_r.*")


def dialogue_commitments(facts: DataFrame, turns: DataFrame, keys: Sequence[str], context: int = 2) -> DataFrame:
    """Proposals and questions in which a speaker asks for work, which the next turn of another one confirms, become actions of the asker.

    facts: fact_id, type, turn_id (last cited); turns: pos, turn_id, speaker, text.  Columns type, owner, confirmed_by, and
    context_ids: the turns up to ``context`` before and after.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    around = F.array_remove(F.collect_list("turn_id").over(w.rowsBetween(-context, context)), F.col("turn_id"))
    t = turns.select(*keys, "turn_id", "speaker", "text", F.lead("turn_id").over(w).alias("_next"), F.lead("speaker").over(w).alias("_who"), F.lead("text").over(w).alias("_said"), around.alias("context_ids"))
    j = facts.join(t, [*keys, "turn_id"], "left")
    ok = F.col("type").isin("proposal", "question") & F.col("text").rlike(OWNER_QUESTION) & (F.col("_who") != F.col("speaker")) & F.col("_said").rlike(CONFIRMED)
    ok = F.coalesce(ok, F.lit(False))
    return j.select(*[c for c in facts.columns if c != "type"], F.when(ok, "action").otherwise(F.col("type")).alias("type"), F.when(ok, F.col("speaker")).alias("owner"), F.when(ok, F.col("_next")).alias("confirmed_by"), F.coalesce("context_ids", none()).alias("context_ids"))
