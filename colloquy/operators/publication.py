"""What may be published: labels, sentence plans against claims, document surfaces and patches, plans of views, admission to a batch."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import state as G
from .sequence import Diverse, Fold, fold


def none() -> Column:
    return F.array().cast("array<string>")

# fixed values: patterns of labels that don't stand by themselves
LABEL_FAULTS = (
    r"(?iuU)^\s*(?:пока\s+что\s+)?(?:я|мы|ты|вы|он|она|оно|они|это|этот|эта|эти|тот|та|те)\b",
    r"(?iuU)(?:\bч[её]\b|\bну\s*,|\bну\s+то\s+есть\b|\bтипа\b|\bсобственно\b|\bчто\s+даю\b|\bдавай\b.{0,32}\b(?:кин|скин)\w*|(?:^|[.!?]\s*)(?:угу|ага|ок(?:ей)?|хорошо)(?:\W|$))",
    r"(?iuU)(?:^|;)\s*(?:есть|имеется|существует|бывает|происходит)\b",
    r"(?iuU)(?:\.{3}|…)$|\b(?:и|или|что|чтобы|из-за|после)\s*$",
    r"(?iuU)^\s*(?:@[\w.-]+|[А-ЯЁ][а-яё-]{1,30}(?:\s+(?:и|/)\s+[А-ЯЁ][а-яё-]{1,30})?)\s+(?:пытал\w*|решил\w*|говор\w*|сказал\w*|отмеча\w*|указыва\w*|предлага\w*|попросил\w*)\b",
    r"(?iuU)^\s*(?:необходимо|нужно|надо|следует|стоит)\b|^\s*.{0,48}\b(?:необходимо|нужно|надо|следует)\b",
    r"(?iuU)^\s*(?:изменения|правки|обновления|корректировки)\s+(?:не\s+)?(?:были\s+)?(?:внесены|сделаны|применены|добавлены)\b",
    r"(?iuU)^\s*(?:спрашивается|возникает\s+вопрос)\b",
)
# fixed values: patterns of what a sentence says beyond its words
NUMBER = r"(?U)((?<!\w)\d+(?:[.,:]\d+)*(?:\s*%)?)"
CAUSAL = r"(?iuU)(\b(?:из-за|поэтому|привел[оа]? к|в результате|для этого)\b)"
NEGATION = r"(?iuU)\b(?:не|нет|нельзя|никогда)\b"
UNSURE = r"(?iuU)\b(?:не\s+уточнено|не\s+подтвержд[её]н[оаы]?|ожидает\s+подтверждения)\b"
CERTAIN = r"(?iuU)\b(?:точно|обязательно|гарантированно|решено|утверждено)\b"
COMPLETED = r"(?iuU)\b(?:проверен[аоы]?|завершен[аоы]?|готов[аоы]?|выполнен[аоы]?|сделан[аоы]?)\b"
CONDITION = r"(?iuU)\b(?:если|когда|после|перед|пока|при|до тех пор)\b"
PERSON = r"(?U)(@[\w.-]+)"
ASSIGNED = r"(?iuU)\b(?:поручено|ответственн(?:ый|ая)|должен|владелец)\b"
TENTATIVE = ("possible", "hypothetical", "unknown", "tentative")
# fixed values: kinds of a view and what a kind is worth there
TECHNICAL = ("trading_rule", "system_rule", "definition", "experimental_result", "metric", "design_choice", "constraint", "dependency")
VIEW_KINDS = {
    "executive": ("decision", "proposal", "current_state", "observation", "problem", "blocker", "action", "follow_up", "question", "trading_rule", "system_rule", "design_choice"),
    "rules": ("trading_rule", "system_rule"), "technical": TECHNICAL, "tasks": ("action", "follow_up"), "experiments": ("hypothesis",), "questions": ("question", "blocker", "schedule"), "minutes": None,
}
VIEW_BOOST = {
    "executive": {"decision": 5, "current_state": 5, "problem": 4, "blocker": 5, "action": 4}, "rules": {"trading_rule": 8, "system_rule": 8}, "technical": dict.fromkeys(TECHNICAL, 5),
    "tasks": {"action": 8, "follow_up": 8}, "experiments": {"hypothesis": 7}, "questions": {"question": 8, "schedule": 6}, "minutes": {},
}
UNVERIFIED = ("verification_unavailable", "insufficient_evidence", "contradicted")
DEFINES = r"(?iuU)\b(?:называется|определяется|это\s+когда|ширина\s*[—–-]\s*ширина)\b"
NOT_WORK = r"(?iuU)\b(?:шутк|ха-ха|смешно)\w*"
DELIVERS = r"(?iuU)\b(?:показ|переда|отправ|сдела|размет|провер|исправ|встро|подготов)\w*"
SLOT_NAME = r"\b[a-z]+_[a-z_]+\b"
# fixed values: statuses of tasks that must be told
TOLD = ("accepted", "self_committed", "explicit_self_commitment", "intent_to_attempt", "in_progress", "past_attempt", "blocked", "completed")
# fixed values: limits of a batch workflow
BATCH_ITEMS, BATCH_POSTS, WEEK_CAP = 12, 6, 5_000_000


def label_faulty(value: Column) -> Column:
    """Whether a chapter label needs repair: empty, long, a single word, a question, or one of the faulty forms."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1"), "[*_`]", "")
    plain = F.trim(F.regexp_replace(plain, "(?U)\\s+", " "))
    words = F.size(F.regexp_extract_all(F.lower(plain), F.lit("([a-zа-яё0-9]+)"), 1))
    out = (plain == "") | (F.length(plain) > 160) | (words < 2) | plain.contains("?")
    for p in LABEL_FAULTS:
        out = out | plain.rlike(p)
    return out


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1))


def _subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, F.coalesce(b, none()))) == 0


def realization_errors(text: str = "text") -> Column:
    """Sorted names of what a sentence says against its plan.

    Plan columns: allowed_numbers, relation_ids, allowed_markers, polarity, modality, conditions, time_scope, allowed_people (arrays of strings).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    solid = lambda xs: F.transform(F.coalesce(xs, none()), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    lower = lambda xs: F.transform(F.coalesce(xs, none()), lambda x: S.fold(x))
    col = lambda c: F.coalesce(F.col(c), none())
    denied, markers = t.rlike(NEGATION), lower(_found(t, CAUSAL))
    tentative = F.arrays_overlap(col("modality"), F.array(*map(F.lit, TENTATIVE)))
    scopes = F.filter(F.transform(col("time_scope"), lambda x: F.replace(S.fold(x), F.lit("ё"), F.lit("е"))), lambda x: x != "")
    plain = F.replace(S.fold(t), F.lit("ё"), F.lit("е"))
    rules = {
        "unplanned_number": ~_subset(solid(_found(t, NUMBER)), solid(F.col("allowed_numbers"))),
        "unsupported_relation_language": (F.size(markers) > 0) & (F.size(col("relation_ids")) == 0) & ~_subset(markers, lower(F.col("allowed_markers"))),
        "negation_not_preserved": F.array_contains(col("polarity"), "negative") & ~denied,
        "unsupported_negation": (F.array_distinct(col("polarity")) == F.array(F.lit("positive"))) & F.regexp_replace(t, UNSURE, "").rlike(NEGATION),
        "modality_upgraded": tentative & t.rlike(CERTAIN), "completion_status_upgraded": tentative & t.rlike(COMPLETED), "condition_not_preserved": (F.size(col("conditions")) > 0) & ~t.rlike(CONDITION),
        "time_scope_not_preserved": (F.size(scopes) > 0) & ~F.exists(scopes, lambda x: plain.contains(x) | plain.contains(F.regexp_replace(x, "^1\\s+", ""))),
        "speaker_or_assignee_not_preserved": ~_subset(_found(t, PERSON), _found(F.concat_ws(" ", col("allowed_people")), PERSON)),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])))


def slot_checks(text: str = "text") -> Column:
    """struct(who, quantity, condition, decision_state): whether the sentence keeps to the plan's people, numbers, conditions and state (columns as above, and decision_state)."""
    t = F.coalesce(F.col(text), F.lit(""))
    col = lambda c: F.coalesce(F.col(c), none())
    people = _found(t, PERSON)
    who = ~t.rlike(ASSIGNED) | ((F.size(people) > 0) & _subset(people, _found(F.concat_ws(" ", col("allowed_people")), PERSON)))
    quantity = (F.size(col("allowed_numbers")) == 0) | _subset(_found(t, NUMBER), col("allowed_numbers"))
    condition = (F.size(col("conditions")) == 0) | t.rlike(CONDITION)
    state = (F.size(col("decision_state")) == 0) | ~S.fold(t).contains("решено") | F.array_contains(col("decision_state"), "accepted")
    return F.struct(who.alias("who"), quantity.alias("quantity"), condition.alias("condition"), state.alias("decision_state"))


# fixed values: what in an answer's text fills a slot of each type
FILLS = {
    "implementation_state": r"(?iuU)\b(?:работа\w*|работал\w*|готов\w*|получил\w*|получен\w*|результат\w*|не\s+сработ\w*|неуспеш\w*|реализ\w*|задерж\w*|не\s+закончен\w*)\b",
    "explanation": r"(?iuU)\b(?:потому|из-за|причин\w*|возможно|гипотез\w*|чтобы)\b",
    "entity": r"(?U)@?[A-ZА-ЯЁ][\w.-]+",
    "action_choice": r"(?iuU)\b(?:сдела\w*|подготов\w*|провер\w*|переда\w*|попроб\w*|выбер\w*|буду\w*)\b",
    "time": r"(?iuU)(?:\b\d{1,2}(?::\d{2})?\b|\b(?:сегодня|завтра|понедельник|вторник|сред\w*|четверг|пятниц\w*|суббот\w*|воскресень\w*)\b)",
    "quantity": r"(?U)(?<!\w)\d+(?:[.,]\d+)?",
    "boolean": r"(?iuU)^\s*(?:нет|неа|(?:да[\s,!.—-]*)+|ага|угу|ну\s+ладно)\b",
}


def slot_entailed(slot_type: Column, answer: Column, question: Column, act: Column, fills: dict[str, str] | None = None) -> Column:
    """Whether an answer's spoken text fills a slot of that type; what is on another subject fills none but states and short replies.

    ``fills``: patterns of slots in place of those of FILLS.
    """
    patterns = FILLS | (fills or {})
    topic = F.size(F.array_intersect(S.context_stems(question), S.context_stems(answer))) > 0
    relevant = topic | (F.size(S.tokens(question)) == 0)
    said = F.coalesce(answer, F.lit(""))
    replies = act.isin("answer", "accept", "reject")
    cases = {
        "implementation_state": F.lit(True), "explanation": relevant, "entity": relevant, "action_choice": relevant, "quantity": relevant, "time": relevant | (act == "answer"), "boolean": replies,
    }
    out = F
    for name, ok in cases.items():
        filled = ok & said.rlike(patterns[name])
        if name == "boolean":
            filled = filled | ((act == "answer") & relevant & (F.trim(said) != ""))
        out = out.when(slot_type == name, filled)
    return F.coalesce(out.otherwise(relevant & act.isin("answer", "assert") & (F.size(S.tokens(said)) >= 2)), F.lit(False))


def sentence_plan_errors(plans: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """(unit_id, errors): claims or relations that don't exist, and claims of several episodes that no relation joins.

    plans: unit_id, claim_ids, relation_ids; claims: claim_id, episode_id; relations: relation_id, source_claim_id, target_claim_id.
    """
    lost = lambda ids, known, key, name: plans.select("unit_id", F.explode(ids).alias(key)).join(known.select(key), key, "left_anti").select("unit_id", F.lit(name).alias("error")).distinct()
    apart = G.cross_episode_allowed(plans, claims, relations).where(~F.col("allowed")).select("unit_id", F.lit("cross_episode_without_relation").alias("error"))
    all_of = lost("claim_ids", claims, "claim_id", "unknown_claim").unionByName(lost("relation_ids", relations, "relation_id", "unknown_relation")).unionByName(apart)
    per = all_of.groupBy("unit_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    return plans.select("unit_id").join(per, "unit_id", "left").select("unit_id", F.coalesce("errors", none()).alias("errors"))


PLAN_FIELDS = ("allowed_numbers", "allowed_markers", "polarity", "modality", "conditions", "time_scope", "allowed_people", "decision_state")


def _union(c: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), none()))))


def item_contracts(items: DataFrame, claims: DataFrame, plans: DataFrame) -> DataFrame:
    """(item_id, n_known, n_planned, the plan's fields): what the claims of each item allow, by themselves and by their smallest plans.

    What a plan adds counts only if the plans of all the item's claims are of one claim each: a plan of several is a union, in
    which one claim's numbers would speak for another.  A claim's own fields come before those of its plan.
    """
    p = plans.select("unit_id", "claim_ids", *[F.coalesce(F.col(c), none()).alias(c) for c in PLAN_FIELDS]).withColumn("claim_id", F.explode(F.array_distinct("claim_ids")))
    least = p.groupBy("claim_id").agg(F.min_by(F.struct(F.size("claim_ids").alias("n"), *PLAN_FIELDS), F.struct(F.size("claim_ids"), "unit_id")).alias("plan"))
    own = claims.select("claim_id", F.coalesce("statement", F.lit("")).alias("_text"), *[F.coalesce(F.col(c), none()).alias(f"own_{c}") for c in PLAN_FIELDS])
    spread = items.select("item_id", F.explode(F.array_distinct("claim_ids")).alias("claim_id")).join(own, "claim_id").join(least, "claim_id", "left")
    said = spread.withColumn("_numbers", _found(F.col("_text"), NUMBER)).withColumn("_people", _found(F.col("_text"), PERSON)).withColumn("_markers", _found(F.col("_text"), CAUSAL))
    per = said.groupBy("item_id").agg(
        F.count("*").alias("n_known"), F.count("plan").alias("n_planned"), F.coalesce(F.min(F.col("plan.n") == 1), F.lit(False)).alias("_single"), _union("_numbers").alias("_numbers"), _union("_people").alias("_people"), _union("_markers").alias("_markers"),
        *[_union(f"own_{c}").alias(f"own_{c}") for c in PLAN_FIELDS], *[_union(f"plan.{c}").alias(f"plan_{c}") for c in PLAN_FIELDS],
    )
    planned = lambda c: F.when(F.col("_single"), F.col(f"plan_{c}")).otherwise(none())
    adds = {"allowed_numbers": "_numbers", "allowed_people": "_people"}
    said = {"allowed_markers": F.when(F.col("_single"), none()).otherwise(F.col("_markers")), **{c: F.col(x) for c, x in adds.items()}}
    both = lambda c: F.array_distinct(F.concat(F.col(f"own_{c}"), said[c], planned(c)))
    first = lambda c: F.when(F.size(f"own_{c}") > 0, F.col(f"own_{c}")).otherwise(planned(c))
    return per.select("item_id", "n_known", "n_planned", *[(both(c) if c in said else first(c)).alias(c) for c in PLAN_FIELDS])


def verify_items(items: DataFrame, claims: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(item_id, errors, ok): every item's text against what its claims allow; an item without known claims can't be supported.

    items: item_id, text, claim_ids, relation_ids, and with ``plans`` evidence_ids; claims: claim_id and the plan's fields (arrays of
    strings), and with ``plans`` statement, evidence_ids, lifecycle; plans: unit_id, claim_ids and the plan's fields.

    Without ``plans`` each claim is its own plan.  With them an empty text, an item without known claims, and one whose
    claims are in no plan are errors of their own; so are unknown claims among known ones, evidence that no claim cites, and
    claims that are no longer active.
    """
    checks = slot_checks()
    slots = F.array_compact(F.array(*[F.when(~checks[c], F.lit(f"slot_{c}")) for c in ("who", "quantity", "condition", "decision_state")]))
    if plans is None:
        spread = items.select("item_id", F.explode("claim_ids").alias("claim_id")).join(claims, "claim_id")
        contract = spread.groupBy("item_id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in PLAN_FIELDS])
        j = items.join(contract, "item_id", "left").withColumn("_known", F.col("polarity").isNotNull())
        for c in PLAN_FIELDS:
            j = j.withColumn(c, F.coalesce(c, none()))
        errors = F.when(~F.col("_known"), F.array(F.lit("unknown_claim"))).otherwise(F.array_sort(F.concat(realization_errors(), slots)))
        return j.select("item_id", errors.alias("errors")).withColumn("ok", F.size("errors") == 0)
    cited = items.select("item_id", F.explode(F.array_distinct("claim_ids")).alias("claim_id")).join(claims.select("claim_id", F.col("evidence_ids").alias("_e"), F.coalesce(F.col("lifecycle"), F.lit("active")).alias("_l")), "claim_id")
    closure = cited.groupBy("item_id").agg(_union("_e").alias("_evidence"), F.max(F.col("_l") != "active").alias("_stale"))
    j = items.join(item_contracts(items, claims, plans), "item_id", "left").join(closure, "item_id", "left")
    for c in PLAN_FIELDS:
        j = j.withColumn(c, F.coalesce(c, none()))
    known, planned = F.coalesce("n_known", F.lit(0)), F.coalesce("n_planned", F.lit(0))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    when = lambda holds, name: F.when(holds, F.lit(name))
    strange = when(F.size(F.array_distinct("claim_ids")) > known, "unknown_claim")
    bare = F.array_compact(F.array(when(empty, "empty_public_text"), when(known == 0, "orphan_public_item"), when((known > 0) & (planned == 0), "claim_outside_plan"), strange))
    beyond = F.array_compact(F.array(strange, when(F.size(F.array_except(F.coalesce("evidence_ids", none()), F.coalesce("_evidence", none()))) > 0, "evidence_outside_closure"), when(F.coalesce("_stale", F.lit(False)), "inactive_claim_published")))
    errors = F.when(empty | (known == 0) | (planned == 0), bare).otherwise(F.concat(realization_errors(), slots, beyond))
    return j.select("item_id", F.array_sort(F.array_distinct(errors)).alias("errors")).withColumn("ok", F.size("errors") == 0)


def mandatory(kind: Column, decision: Column, task: Column, question: Column, protected: Column) -> Column:
    """Whether a claim may not be left out: accepted decisions, tasks that were taken on, open questions, blockers, corrections, results, schedules."""
    out = (
        F.when(kind.isin("decision", "proposal"), decision == "accepted").when(kind.isin("action", "follow_up"), task.isin(*TOLD))
        .when(kind == "question", ~F.coalesce(question, F.lit("")).isin("answered", "rhetorical", "superseded")).otherwise(kind.isin("blocker", "correction", "experimental_result", "schedule") | F.coalesce(protected, F.lit(False)))
    )
    return F.coalesce(out, F.lit(False))


def utility(view: str, score: Column, kind: Column, text: Column, risk: Column, must: Column, verification: Column) -> Column:
    """What a claim is worth in a view: its score, the view's liking, safety, duty, less what makes it poor."""
    boosts = VIEW_BOOST[view]
    boost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), kind), F.lit(0)) if boosts else F.lit(0)
    t = F.coalesce(text, F.lit(""))
    penalty = (
        4 * t.rlike(DEFINES).cast("int") + 8 * t.rlike(NOT_WORK).cast("int") + 4 * (kind.isin("action", "follow_up") & ~t.rlike(DELIVERS)).cast("int") + 8 * t.rlike(SLOT_NAME).cast("int")
        + 4 * F.coalesce((verification == "verification_unavailable").cast("int"), F.lit(0))
    )
    closing = F.when(kind == "schedule", 8).otherwise(0) if view == "questions" else F.lit(0)
    return score + boost + 2 * (1 - F.coalesce(risk, F.lit(0.0))) + 2 * must.cast("int") + closing - penalty


# fixed values: statements that two of the views leave out
NOT_IN_VIEW = {"minutes": r"(?iuU)\b(?:сделать\s+упор|сосредоточиться|ещ[её]\s+над\s+этим\s+посидеть)\b", "technical": r"(?iuU)\b(?:ширина\s*[—–-]\s*ширина|называется|определяется)\b"}
UNIT_CLAIMS = 4


class Units(Fold):
    """Claims of a view in order of time: each one that is in no unit yet opens one with the chosen claims that relations join to it."""

    def __init__(self, most: int = UNIT_CLAIMS) -> None:
        self.most, self.n, self.done = most, 0, set()

    def row(self, r: dict) -> Iterable[dict]:
        if r["claim_id"] in self.done:
            return ()
        ids, used, left = [r["claim_id"]], [], []
        for link in r["links"] or ():
            if link["chosen"] and len(ids) < self.most:
                ids.append(link["other"])
                used.append(link["relation_id"])
            else:
                left.append(link["relation_id"])
        self.done.update(ids)
        self.n += 1
        return ({"unit_id": f"SU{self.n:04d}", "central_claim_id": r["claim_id"], "claim_ids": ids, "relation_ids": used, "unresolved_edges": left, "role": "state_change" if r["mandatory"] else "technical_context"},)


def summary_units(chosen: DataFrame, relations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, view, unit_id, central_claim_id, claim_ids, relation_ids, unresolved_edges, role): the chosen claims of each view by what relates them.

    chosen: keys, view, claim_id, start, mandatory; relations: keys, relation_id, source_claim_id, target_claim_id.
    """
    of = [*keys, "view"]
    end = lambda a, b: relations.select(*keys, "relation_id", F.col(a).alias("claim_id"), F.col(b).alias("other"))
    ends = end("source_claim_id", "target_claim_id").unionByName(end("target_claim_id", "source_claim_id").where("claim_id <> other"))
    mate = chosen.select(*of, F.col("claim_id").alias("other"), F.lit(True).alias("chosen"))
    met = chosen.select(*of, "claim_id").join(ends, [*keys, "claim_id"]).join(mate, [*of, "other"], "left")
    links = met.groupBy(*of, "claim_id").agg(F.array_sort(F.collect_list(F.struct("relation_id", "other", F.coalesce("chosen", F.lit(False)).alias("chosen")))).alias("links"))  # relations of one claim
    kind = chosen.schema["claim_id"].dataType.simpleString()
    rows = chosen.select(*of, "claim_id", "start", F.coalesce("mandatory", F.lit(False)).alias("mandatory")).join(links, [*of, "claim_id"], "left")
    return fold(rows, of, ["start", "claim_id"], Units, f"unit_id string, central_claim_id {kind}, claim_ids array<{kind}>, relation_ids array<string>, unresolved_edges array<string>, role string")


def sentence_contracts(units: DataFrame, claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each unit's sentence may say, as ``verify_items`` takes it: the numbers, markers and people of its claims' statements, and their own fields in order.

    claims: keys, claim_id, statement, time_scope, speaker_refs, assignee, polarity, modality, conditions, decision_status.
    """
    of = [*keys, "view", "unit_id"]
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c)).otherwise(none())
    text = F.concat_ws(" ", "statement", "time_scope")
    c = claims.select(
        *keys, "claim_id", _found(text, NUMBER).alias("allowed_numbers"), _found(F.coalesce("statement", F.lit("")), CAUSAL).alias("allowed_markers"), F.concat(F.coalesce("speaker_refs", none()), one("assignee")).alias("allowed_people"),
        one("polarity").alias("polarity"), one("modality").alias("modality"), F.coalesce("conditions", none()).alias("conditions"), one("time_scope").alias("time_scope"), one("decision_status").alias("decision_state"),
    )
    spread = units.select(*of, F.posexplode("claim_ids").alias("_k", "claim_id")).join(c, [*keys, "claim_id"])
    gathered = lambda f: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_k", f))), lambda x: x[f])).alias(f)  # noqa: E731  at most UNIT_CLAIMS rows
    per = spread.groupBy(*of).agg(*[gathered(f) for f in PLAN_FIELDS])
    return units.select(*of, "claim_ids", "relation_ids").join(per, of, "left").select(*of, "claim_ids", "relation_ids", *[F.coalesce(f, none()).alias(f) for f in PLAN_FIELDS])


def plan(claims: DataFrame, keys: Sequence[str], budgets: dict[str, int], alike: float = 0.78) -> DataFrame:
    """(keys, view, claim_id, place): the claims of every view, best first; duties always, others while the budget lasts and unless like one taken.

    claims: claim_id, kind, statement, start, score, risk, decision_status, task_status, question_status, protected, task_state_id, verification,
    and where they are known lifecycle, dialogue_only and canonical_task_anchor: only active claims that are more than dialogue are planned, in ``tasks`` only anchors.
    In ``tasks`` each task state that is not told yet adds its first claim; ``requires_verification`` has what could not be verified.
    """
    must = mandatory(F.col("kind"), F.col("decision_status"), F.col("task_status"), F.col("question_status"), F.col("protected"))
    c = claims.withColumn("mandatory", must)
    known = lambda name, otherwise: F.coalesce(F.col(name), F.lit(otherwise)) if name in claims.columns else F.lit(otherwise)
    fine = c.where(~F.coalesce(F.col("verification"), F.lit("")).isin(*UNVERIFIED) & (known("lifecycle", "active") == "active") & ~known("dialogue_only", False))
    rows = None
    for view, kinds in VIEW_KINDS.items():
        v = fine if kinds is None else fine.where(F.col("kind").isin(*kinds) | (F.col("task_state_id").isNotNull() if view == "tasks" else F.lit(False)))
        if view in NOT_IN_VIEW:
            v = v.where(~F.coalesce("statement", F.lit("")).rlike(NOT_IN_VIEW[view]))
        if view == "tasks":
            v = v.where(known("canonical_task_anchor", True))
        if view == "questions":
            v = v.where(~F.coalesce("question_status", F.lit("")).isin("answered", "rhetorical", "superseded", "answer_not_verified", "answer_retrieval_failed"))
        worth = utility(view, F.col("score"), F.col("kind"), F.col("statement"), F.col("risk"), F.col("mandatory"), F.col("verification"))
        v = v.select(*keys, F.lit(view).alias("view"), F.col("claim_id").alias("item_id"), "statement", "mandatory", "start", F.bround(-worth, 9).alias("_u"))
        rows = v if rows is None else rows.unionByName(v)
    # duties come first, in order of time; then by worth
    rows = rows.withColumn("_o", F.when(F.col("mandatory"), F.col("start")).otherwise(F.col("_u"))).withColumn("_d", (~F.col("mandatory")).cast("int"))
    kind = claims.schema["claim_id"].dataType.simpleString()
    table = dict(budgets)
    taken = fold(rows.select(*keys, "view", "item_id", "statement", "mandatory", "start", "_o", "_d"), [*keys, "view"], ["_d", "_o", "start", "item_id"], lambda: ByView(table, alike), f"item_id {kind}, place int").withColumnRenamed("item_id", "claim_id")
    told = taken.where("view = 'tasks'").join(claims.select(*keys, "claim_id", "task_state_id"), [*keys, "claim_id"]).select(*keys, "task_state_id").distinct()
    missing = fine.where("task_state_id is not null").join(told, [*keys, "task_state_id"], "left_anti")
    first = missing.groupBy(*keys, "task_state_id").agg(F.min_by("claim_id", F.struct("start", "claim_id")).alias("claim_id")).select(*keys, F.lit("tasks").alias("view"), "claim_id", F.lit(None).cast("int").alias("place"))
    unsure = c.where(F.coalesce(F.col("verification"), F.lit("")).isin(*UNVERIFIED)).select(*keys, F.lit("requires_verification").alias("view"), "claim_id", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "claim_id")).alias("place"))
    return taken.select(*keys, "view", "claim_id", "place").unionByName(first).unionByName(unsure)


class ByView(Diverse):
    """Diverse choice with the budget of the view that the rows are of."""

    def __init__(self, budgets: dict[str, int], limit: float) -> None:
        super().__init__(0, limit)
        self.budgets = budgets

    def row(self, r: dict):
        self.budget = self.budgets.get(r["view"], 0)
        return super().row(r)


def public_items(claims: DataFrame, tasks: DataFrame, questions: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each chosen claim of a view with its text and state: (view, item_key, claim_id, section, text, status).

    claims: claim_id, kind, statement; tasks: claim_id, status, owner; questions: claim_id, status, remaining; chosen: view, claim_id.
    """
    t = tasks.select("claim_id", F.struct("status", "owner").alias("_t"))
    q = questions.select("claim_id", F.struct("status", "remaining").alias("_q"))
    j = chosen.select("view", "claim_id").join(claims, "claim_id").join(t, "claim_id", "left").join(q, "claim_id", "left")
    section = F.when(F.col("_t").isNotNull(), "tasks").when(F.col("_q").isNotNull(), "questions").when(F.col("kind").isin("decision", "proposal"), "decisions").when(F.col("kind").isin(*TECHNICAL), "technical").otherwise("overview")
    text = F.coalesce(F.when(F.col("_t.owner").isNotNull(), F.concat_ws(": ", "_t.owner", "statement")), F.col("_q.remaining"), F.col("statement"))
    return j.select("view", S.stable_id("PI", S.canonical_json({"claim": "claim_id", "view": "view"})).alias("item_key"), "claim_id", section.alias("section"), text.alias("text"), F.coalesce("_t.status", "_q.status").alias("status"))


# fixed values: which view a document's section is
SECTION_VIEWS = {"overview": "executive", "technical": "technical", "tasks": "tasks", "decisions": "decisions", "rules": "mentioned_rules", "experiments": "experiments", "questions": "open_questions", "outcome_cards": "minutes"}


def project_document(rows: DataFrame) -> DataFrame:
    """Rows of a verified document (section, ...) under the names of the views; other sections are not published."""
    return rows.where(F.col("section").isin(*SECTION_VIEWS)).withColumn("view", F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_VIEWS.items() for x in kv]), F.col("section"))).drop("section")


def lineage(candidates: DataFrame, claims: DataFrame, rejected: DataFrame, quarantined: DataFrame) -> DataFrame:
    """(candidate_id, outcome): where every early candidate went: claim, rejection, quarantine, or lost; the first that holds.

    The others: candidate_id, each perhaps on several rows.
    """
    out = candidates.select("candidate_id").distinct()
    for name, rows in (("claim", claims), ("rejection", rejected), ("quarantine", quarantined)):
        out = out.join(rows.select("candidate_id").distinct().withColumn(f"_{name}", F.lit(name)), "candidate_id", "left")
    return out.select("candidate_id", F.coalesce("_claim", "_rejection", "_quarantine", F.lit("lost")).alias("outcome"))


def surfaces(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every field of a document's items as a surface of its own: surface_id, path, value, source_ids.

    items: section, place, source_ids and the fields (text); a field that is null has no surface.
    """
    spread = items.select("section", "place", "source_ids", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])).alias("field", "value")).where("value is not null")
    path = F.concat_ws(".", "section", F.col("place").cast("string"), "field")
    return spread.select(S.stable_id("s-", path).alias("surface_id"), path.alias("path"), "value", F.coalesce("source_ids", none()).alias("source_ids"))


def patch_faults(bundles: DataFrame, operations: DataFrame, findings: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, id) of what is wrong with a patch plan: unknown targets, findings not accounted for once, dependencies unknown or in a circle.

    bundles: bundle_id, finding_ids, depends_on; operations: bundle_id, kind, target_id, path; findings: finding_id; known: surface_id, path.
    """
    replaces = F.col("kind").isin("replace_field", "update_task")
    bad = operations.join(known.select(F.col("surface_id").alias("target_id"), F.col("path").alias("_p")), "target_id", "left")
    allowed = F.when(replaces, F.col("_p").eqNullSafe(F.col("path")) & ((F.col("kind") != "update_task") | F.col("path").startswith("tasks."))).otherwise(F.col("kind").isin("add_section_item", "create_task") & F.col("target_id").isNull() & ((F.col("kind") == "create_task") == (F.col("path") == "tasks")))
    faults = bad.where(~F.coalesce(allowed, F.lit(False))).select(F.lit("target").alias("kind"), F.col("bundle_id").alias("id")).distinct()
    counted = bundles.select(F.explode("finding_ids").alias("finding_id")).groupBy("finding_id").agg(F.count("*").alias("n"))
    once = findings.select("finding_id").distinct().withColumn("_f", F.lit(1)).join(counted, "finding_id", "full").where("_f is null or n is null or n <> 1")
    faults = faults.unionByName(once.select(F.lit("finding").alias("kind"), F.col("finding_id").alias("id")))
    needs = bundles.select("bundle_id", F.explode("depends_on").alias("need"))
    ids = bundles.select("bundle_id").distinct()
    faults = faults.unionByName(needs.join(ids.withColumnRenamed("bundle_id", "need"), "need", "left_anti").select(F.lit("dependency").alias("kind"), F.col("bundle_id").alias("id")).distinct())
    left = G.cut(ids)
    n = left.count()
    while True:  # bundles go once all they need is gone, one a round at least; those of a circle stay
        waits = needs.join(left.withColumnRenamed("bundle_id", "need"), "need", "left_semi").select("bundle_id").distinct()
        left, before = G.cut(left.join(waits, "bundle_id", "left_semi")), n
        n = left.count()
        if n == before:
            break
    return faults.unionByName(left.select(F.lit("cycle").alias("kind"), F.col("bundle_id").alias("id")))


def apply_patch(items: DataFrame, replacements: DataFrame, insertions: DataFrame) -> DataFrame:
    """Items of sections (section, place, text) after a patch: texts replaced, then new ones put behind their anchors (or at the end), numbered anew.

    replacements: section, place, text, before (hash of the text it replaces; another one leaves the item as it is);
    insertions: section, after (place, null: the end), seq, text.  Column changed: replaced, inserted, stale or null.
    """
    r = replacements.select("section", "place", F.col("text").alias("_new"), F.col("before").alias("_before"))
    j = items.join(r, ["section", "place"], "left")
    same = F.sha2("text", 256) == F.col("_before")
    changed = F.when(F.col("_before").isNull(), F.lit(None).cast("string")).when(same, "replaced").otherwise("stale")
    kept = j.select("section", F.col("place").cast("double").alias("_at"), F.lit(-1).cast("long").alias("_seq"), F.when(F.coalesce(same, F.lit(False)), F.col("_new")).otherwise(F.col("text")).alias("text"), changed.alias("changed"))
    new = insertions.select("section", F.coalesce(F.col("after").cast("double"), F.lit(float("inf"))).alias("_at"), F.col("seq").cast("long").alias("_seq"), "text", F.lit("inserted").alias("changed"))
    w = Window.partitionBy("section").orderBy("_at", "_seq")
    return kept.unionByName(new).select("section", (F.row_number().over(w) - 1).alias("place"), "text", "changed")


class Admission(Fold):
    """Intents of one workflow in order, each seeing what those before it reserved."""

    def __init__(self) -> None:
        self.attempts = self.posts = self.items = self.cost = None
        self.seen: dict[str, tuple] = {}

    def reason(self, r: dict) -> str | None:
        if r["_status"] is None:
            return "unknown_workflow"
        if r["_status"] != "active":
            return "workflow_not_active"
        if not 0 < (r["planned"] or 0) <= WEEK_CAP:
            return "workflow_plan_not_reserved"
        if self.items + r["items"] > BATCH_ITEMS:
            return "logical_job_item_limit"
        if max(self.attempts, self.posts) >= BATCH_POSTS:
            return "logical_job_dispatch_limit"
        if self.cost + r["reserve"] > r["planned"]:
            return "logical_job_budget_exceeded"
        return "weekly_budget_exceeded" if r["spent_microusd"] > WEEK_CAP else None

    def row(self, r: dict) -> Iterable[dict]:
        if self.items is None:
            self.attempts, self.posts, self.items, self.cost = (r[c] or 0 for c in ("_n", "_posts", "_items", "_cost"))
        out = {"intent_id": r["intent_id"], "decision": "blocked", "attempt_id": None}
        shape = (r["workflow_id"], r["stage"], r["payload_sha256"], r["reserve"], r["items"])
        prior = self.seen.get(r["intent_key"]) or ((r["_attempt"], (r["_workflow"], r["_stage"], r["_payload"], r["_reserved"], r["_count"])) if r["_attempt"] is not None else None)
        if r["_status"] is not None and prior:  # a replay counts nothing; under another shape it is refused
            return ({**out, "decision": "pending", "attempt_id": prior[0], "reason": None} if prior[1] == shape else {**out, "reason": "intent_identity_changed"},)
        reason = self.reason(r)
        if reason is None:
            attempt = r["intent_key"]
            self.seen[attempt] = (attempt, shape)
            self.attempts, self.items, self.cost = self.attempts + 1, self.items + r["items"], self.cost + r["reserve"]
            return ({**out, "decision": "new", "attempt_id": attempt, "reason": None},)
        return ({**out, "reason": reason},)


def admit_batch(intents: DataFrame, workflows: DataFrame, attempts: DataFrame, spent: DataFrame) -> DataFrame:
    """(intent_id, workflow_id, decision, attempt_id, reason): new, pending (a replay of an admitted intent) or blocked by the first limit it breaks.

    Intents of a workflow are decided one after another (by created_at, then intent_id); one that is admitted counts for those after it.
    An intent_key stands for one intent of one workflow, ever.  The week's money needs no such order: an active workflow holds its whole plan, so what is admitted within it spends nothing more.

    intents: intent_id, intent_key, workflow_id, stage, payload_sha256, items, reserve, created_at; workflows: workflow_id, status, planned;
    attempts: attempt_id, intent_key, workflow_id, stage, payload_sha256, status, posts, items, reserved, billed; spent: one row, spent_microusd of the week.
    """
    cost = F.when(~F.col("status").isin("rejected_no_charge", "cancelled_before_submit"), F.coalesce("billed", "reserved")).otherwise(0)
    per = attempts.groupBy("workflow_id").agg(F.count("*").alias("_n"), F.sum("posts").alias("_posts"), F.sum("items").alias("_items"), F.sum(cost).alias("_cost"))
    prior = attempts.select(F.col("workflow_id").alias("_workflow"), "intent_key", F.col("attempt_id").cast("string").alias("_attempt"), F.col("stage").alias("_stage"), F.col("payload_sha256").alias("_payload"), F.col("reserved").alias("_reserved"), F.col("items").alias("_count"))
    j = intents.join(workflows.select("workflow_id", F.col("status").alias("_status"), "planned"), "workflow_id", "left").join(per, "workflow_id", "left").join(prior, "intent_key", "left").join(F.broadcast(spent))  # one row
    return fold(j, ["workflow_id"], ["created_at", "intent_id"], Admission, "intent_id bigint, decision string, attempt_id string, reason string").select("intent_id", "workflow_id", "decision", "attempt_id", "reason")


def audit(items: DataFrame) -> DataFrame:
    """One row of counts over published items, and whether the gates hold.

    items: item_key, section, text, claim_ids, evidence_ids, ok (of the item's check), mandatory, published.
    """
    shown = F.col("published")
    n = lambda c: F.count_if(c).alias
    counts = items.agg(
        n(shown)("published"), n(shown & ~F.col("ok"))("unverified"), n(shown & (F.size("claim_ids") == 0))("without_claims"), n(shown & (F.size("evidence_ids") == 0))("without_evidence"), n(F.col("mandatory") & ~shown)("mandatory_missing"),
        n(shown & label_faulty(F.col("text")))("poor_labels"), (F.count_if(shown) - F.count_distinct(F.when(shown, F.struct("section", S.squeezed("text"))))).alias("duplicates"),
    )
    return counts.withColumn("passed", (F.col("unverified") == 0) & (F.col("without_claims") == 0) & (F.col("without_evidence") == 0) & (F.col("mandatory_missing") == 0) & (F.col("duplicates") == 0))


def document_faults(lines: DataFrame, items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(kind, id): published items that a document's lines don't have, lines of no item, links to anchors that don't exist, labels that need repair.

    lines: line_id, item_key, text, target; items: item_key, text; anchors: target.
    """
    both = items.select("item_key", F.col("text").alias("_t")).join(lines.select("item_key", "line_id", "text", "target"), "item_key", "full")
    lost = both.where("line_id is null").select(F.lit("missing item").alias("kind"), F.col("item_key").alias("id"))
    strange = both.where("_t is null").select(F.lit("unknown item").alias("kind"), F.col("line_id").alias("id"))
    other = both.where("_t is not null and line_id is not null and not (text <=> _t)").select(F.lit("changed text").alias("kind"), F.col("item_key").alias("id"))
    dead = lines.where("target is not null").join(anchors.select("target").distinct(), "target", "left_anti").select(F.lit("dead link").alias("kind"), F.col("line_id").alias("id"))
    poor = lines.where(label_faulty(F.col("text"))).select(F.lit("poor label").alias("kind"), F.col("line_id").alias("id"))
    return lost.unionByName(strange).unionByName(other).unionByName(dead).unionByName(poor)


