"""Semantic records: what a model says of a fact, kept only as far as the fact's own evidence bears it out.

facts: fact_id, type, topic, statement, certainty, start, evidence_ids, evidence (array of id, speaker, text in
order of time), owner_refs, speaker_refs, entities, verification_status, and ``raw``, a struct of RAW's type with what the model says.
Everything works within a row, on arrays that are as long as a fact's evidence; ``with_evidence`` brings the turns to the facts.

Owners come from ``owner_refs``, or from the one speaker whose own turns promise the work or tell of it.
Confirmations of work count from its owner only; quantities only where a cited turn has their number; roles and
objects of actions only where a cited turn has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.meeting import content_kind
from .dialogue import modality_axis

RAW = (
    "struct<confirmation_evidence_ids:array<string>,proposed_by:array<string>,conditions:array<struct<predicate:string,effect:string,evidence_ids:array<string>>>,"
    "quantities:array<struct<value:string,unit:string,entity:string,role:string,dimension:string,metric_status:string,evidence_ids:array<string>>>,question_status:string,answer_evidence_ids:array<string>,"
    "answer_record_ids:array<string>,speech_act:string,modality:string,content_kind:string,predicate:string,object:string,polarity:string,time_expression:string,timezone:string,requested_slots:array<string>,answered_slots:array<string>,"
    "actions:array<struct<action_id:string,actor:string,predicate:string,object:string,recipient:string,temporal_state:string,commitment_state:string,parallel:boolean,evidence_ids:array<string>>>>"
)
CLAUSE = "actor string, predicate string, object string, parallel boolean, temporal_state string, commitment_state string, evidence_ids array<string>"

# fixed values: what conditions, questions and turns about one's own work look like
CONDITION = r"(?iuU)^\s*(?:если|когда|после|перед|пока|при|до|в случае|при условии|только если|if|when|after|before|until|provided)(?:\W|$)"
UNRESOLVED = r"(?iuU)(?:нужно уточнить|необходимо уточнить|требует проверки|не установлено|определить нельзя|нельзя определить|остался вопрос|нет подтверждения|подтверждения\w*(?:\s+\w+){0,6}\s+нет|спрашива(?:ет|ют|л|ли) о возможности)"
RESOLVED = r"(?iuU)(?:в ответ|пояснил|пояснила|не рекомендовал|уточнил, что|уточнила, что|далее обсуждались|затем предложили|в ответе)"
OF_TRANSCRIPT = r"(?iuU)(?:по аудио|в аудио|в стенограмме|распозн|реплик\w*\s+(?:оборван|обрыва)|окончание фразы|точн\w*\s+формулировк\w*|конкретн\w*\s+значен\w*\s+определить нельзя|нельзя уверенно (?:разобрать|восстановить|определить))"
OF_DISCUSSION = r"(?iuU)(?:следующ\w*\s+созвон|подтверждения времени.*нет|остался вопрос,?\s+где)"
VERBS = (
    r"(?:сдела(?:ть|ю|ем)|созда(?:ть|м|дим)|подготов(?:ить|лю|им)|переда(?:ть|м|дим)|отправ(?:ить|лю|им)|предостав(?:ить|лю|им)|размеч(?:ать|ивать|у|аю|иваю|аем|иваем)|встро(?:ить|ю|им)|"
    r"провер(?:ить|ю|им)|исправ(?:ить|лю|им)|продолж(?:ить|у|им)|экспериментир(?:овать|ую|уем)|реализ(?:овать|ую|уем)|добав(?:ить|лю|им)|подключ(?:ить|у|им)|скин(?:уть|у|ем)|показ(?:ать|жу|ем))"
)
PROMISE = (
    r"(?iuU)\bя\b[^.!?\n]{0,120}\b(?:буду|сделаю|создам|подготовлю|передам|отправлю|предоставлю|пришлю|скину|кину|дам|размечу|встрою|проверю|исправлю|продолжу|реализую|добавлю|подключу|покажу)\b|"
    r"\b(?:сделаю|создам|подготовлю|передам|отправлю|предоставлю|пришлю|скину|кину|размечу|встрою|проверю|исправлю|продолжу|покажу)\b"
)
OWN_TASK = r"(?iuU)\bмне\b[^.!?\n]{0,80}\b(?:сделать|создать|подготовить|передать|отправить|предоставить|размечать|разметить|встроить|проверить|исправить|продолжить|экспериментировать|реализовать|добавить|подключить)\b"
ONSET = r"\bя\b(?:(?!\b(?:он|она|они|ты|вы)\b)[^.!?\n]){0,80}\b(?:пош[её]л|пошла|начал|начала|приступил|приступила)\b[^.!?\n]{0,30}"
PROGRESS = r"(?iuU)\bя\b[^.!?\n]{0,80}\b(?:делаю|создаю|готовлю|передаю|отправляю|размечаю|встраиваю|проверяю|исправляю|продолжаю|экспериментирую|реализую|добавляю|подключаю|анализирую|работаю|рисую|пишу)\b|" + ONSET + r"\b[а-яё-]+(?:ть|ти)\b"
PAST = r"(?iuU)\bя\b[^.!?\n]{0,100}\b(?:пробовал(?:а)?|попробовал(?:а)?|пытал(?:ся|ась)|делал(?:а)?|проверял(?:а)?|экспериментировал(?:а)?|занимал(?:ся|ась)|реализовал(?:а)?|добавлял(?:а)?|анализировал(?:а)?)\b"
TRY = r"(?iuU)\bя\b[^.!?\n]{0,80}\b(?:попробую|попытаюсь|хочу\s+попробовать)\b"
INTERNAL = r"(?i)^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"
RULE = (
    r"(?iuU)(?=.*\b(?:если|когда|при|как\s+только|после\s+того\s+как|до\s+того\s+как)\b)(?=.*\b(?:нужно|надо|следует|требуется|разрешено|запрещено|обязательно|"
    r"[a-zа-яё-]{3,}(?:ется|ются|ается|яются|ится|ятся|ывается|иваются|ируется|ируются|уется|уются))\b)"
)
LEADING = r"(?iuU)\b(?:я|мы|мне|нам|тогда|потом|затем|дальше|сейчас|буду|будем|нужно|надо|хочу|пытаюсь|пош[её]л|пошла|начал|начала|приступил|приступила)\b"
TRAILING = r"(?iuU)\s+(?:и\s+пойти|и|а|затем|потом|дальше|пойти)\s*$"
NEXT_SUBJECT = r"(?iuU)(?:^|[,;]?\s+)(?:и|а)\s+(?:параллельно\s+)?(?:я|мы|он|она|они|вы|ты)\b"
AFTER_ZERO = r"(?iuU)\bпосле\s+0{1,2}(?::0{2})?\b"
NUMBER_WORDS = {
    1: ("один", "одна", "одно", "одну", "одного"), 2: ("два", "две", "двух"), 3: ("три", "трёх", "трех"), 4: ("четыре", "четырёх", "четырех"), 5: ("пять", "пяти"),
    6: ("шесть", "шести"), 7: ("семь", "семи"), 8: ("восемь", "восьми"), 9: ("девять", "девяти"), 10: ("десять", "десяти"),
}
DIMENSIONS = {"timeframe": r"(?iuU)\b(?:таймфрейм|свеч\w*|h\d+|m\d+|часов\w*)\b", "duration": r"(?iuU)\b(?:месяц|недел|д(?:ень|ня|ней)|длительн|отрезок)\b", "percentage": r"(?iuU)\bпроцент|%"}
YEARS = r"(?iuU)\b(?:год|года|году|данн\w*|истори\w*)\b"
ROUGHLY = r"(?iuU)\b(?:примерно|около|где-то|порядка)\b"
INDEX = r"(?iuU)\b(?:индекс|позици|окн[оа]|свеч[аи])\w*\b"
ACTS = ("assert", "propose", "ask", "answer", "commit", "accept", "reject", "correct", "decide")
MODALITIES = ("asserted", "tentative", "proposed", "committed", "question")
TEMPORAL = ("planned", "in_progress", "past_attempt", "completed", "unknown")
COMMITMENTS = ("none", "intent_to_attempt", "explicit_commitment", "accepted_assignment", "unknown")
EDGES = " ,.;:!?—-\""

STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(STRINGS)


def _list(c: Column) -> Column:
    return F.coalesce(c, _none())


def _said(c: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _within(ids: Column, among: Column) -> Column:
    return F.filter(_list(ids), lambda x: F.array_contains(among, x))


def _cited(evidence: Column, ids: Column) -> Column:
    """The texts that ``ids`` name, in the order of the ids, joined."""
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(F.filter(evidence, lambda e: e["id"] == i), F.lit(0))["text"], F.lit(""))), " ")


def with_evidence(facts: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """``facts`` with the column evidence: the turns (keys, id, speaker, text, start) that evidence_ids names, in order of time."""
    cited = facts.select(*keys, "fact_id", F.explode(F.array_distinct("evidence_ids")).alias("id"))
    turn = F.struct("start", "id", "speaker", "text")
    found = cited.join(turns.select(*keys, "id", "speaker", "text", "start"), [*keys, "id"]).groupBy(*keys, "fact_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t.dropFields("start")).alias("evidence"))
    return facts.join(found, [*keys, "fact_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<struct<id:string,speaker:string,text:string>>")))


def _speakers(turns: Column, *patterns: str) -> Column:
    """Distinct speakers of turns that match a pattern, in order."""
    def hit(t: Column) -> Column:
        out = F.lit(not patterns)
        for p in patterns:
            out = out | F.coalesce(t["text"].rlike(p), F.lit(False))
        return (F.coalesce(t["speaker"], F.lit("")) != "") & out

    return F.array_distinct(F.transform(F.filter(turns, hit), lambda t: t["speaker"]))


def owners(facts: DataFrame) -> DataFrame:
    """Adds owners, confirmation_evidence_ids, proposed_by and, as struct ``own``, what the evidence says of the owner's work."""
    ev = F.col("evidence")
    f = facts.withColumn("_speakers", _speakers(ev)).withColumn("_work", _speakers(ev, PROGRESS, PAST)).withColumn("_any", _speakers(ev, PROMISE, OWN_TASK, PROGRESS, PAST))
    f = f.withColumn("_audited", _within(F.col("owner_refs"), F.col("_speakers"))).withColumn("_promised", F.coalesce(F.col("statement").rlike(S.COMMITMENT), F.lit(False)))
    work = (F.col("type") == "action") | F.col("_promised")
    lone = lambda c: F.when(F.size(c) == 1, F.col(c)).otherwise(_none())
    audited = lambda other: F.when(F.size("_audited") > 0, F.col("_audited")).otherwise(other)
    f = f.withColumn("owners", F.when(work, audited(lone("_any"))).when(F.size("_work") == 1, audited(F.col("_work"))).otherwise(_none()))
    confirmed = _within(F.col("raw.confirmation_evidence_ids"), F.col("evidence_ids"))
    by_owner = lambda i: F.exists(F.col("evidence"), lambda e: (e["id"] == i) & F.array_contains(F.col("owners"), e["speaker"]))
    f = f.withColumn("confirmation_evidence_ids", F.when(work, F.filter(confirmed, by_owner)).otherwise(confirmed))
    f = f.withColumn("proposed_by", F.when(F.col("type").isin("proposal", "action"), _within(F.col("raw.proposed_by"), F.col("_speakers"))).otherwise(_none()))
    text = F.when(F.size("owners") == 1, F.array_join(F.transform(F.filter("evidence", lambda e: e["speaker"] == F.col("owners")[0]), lambda e: F.coalesce(e["text"], F.lit(""))), " ")).otherwise("")
    f = f.withColumn("_own", text)
    own = F.struct(F.col("_own").rlike(PROMISE).alias("promise"), F.col("_own").rlike(PROGRESS).alias("progress"), F.col("_own").rlike(PAST).alias("past"), work.alias("work"), (F.size("_work") == 1).alias("lifecycle"), F.col("_promised").alias("statement"))
    return f.withColumn("own", own).drop("_speakers", "_work", "_any", "_audited", "_promised", "_own")


def conditions(raw: Column, evidence_ids: Column) -> Column:
    kind = "array<struct<predicate:string,effect:string,evidence_ids:array<string>>>"
    made = F.transform(raw["conditions"], lambda c: F.struct(_said(c["predicate"]).alias("predicate"), _said(c["effect"]).alias("effect"), _within(c["evidence_ids"], evidence_ids).alias("evidence_ids")))
    return F.coalesce(F.filter(made, lambda c: c["predicate"].rlike(CONDITION) & (F.size(c["evidence_ids"]) > 0)), F.array().cast(kind))


def quantities(raw: Column, evidence_ids: Column, evidence: Column) -> Column:
    """Quantities whose number a cited turn has, in digits or (1 to 10) as a word."""
    def cite(q: Column) -> Column:
        ids = _within(q["evidence_ids"], evidence_ids)
        return F.struct(q.alias("q"), ids.alias("ids"), F.lower(_cited(evidence, ids)).alias("text"), F.coalesce(F.trim(q["value"]), F.lit("")).alias("amount"))

    def numbers(text: Column, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))

    def in_words(n: Column, text: Column) -> Column:
        out = F.lit(False)
        for k, words in NUMBER_WORDS.items():
            out = out | ((n == k) & text.rlike(rf"(?iuU)\b(?:{'|'.join(words)})(?:часов\w*|дневн\w*|месячн\w*|летн\w*)?\b"))
        return out

    def borne_out(c: Column) -> Column:
        there = numbers(c["text"], r"(?<!\d)\d+(?:[.,]\d+)?(?!\d)")
        return (F.size(c["ids"]) > 0) & F.exists(numbers(c["amount"], r"\d+(?:[.,]\d+)?"), lambda n: F.exists(there, lambda m: F.abs(n - m) < 1e-9) | in_words(n, c["text"]))

    def made(c: Column, k: Column) -> Column:
        q, text = c["q"], c["text"]
        offset = c["amount"].startswith("-") & text.rlike(INDEX)
        value = F.replace(c["amount"], F.lit(","), F.lit(".")).try_cast("double")
        unit = _said(q["unit"])
        kind = F.when((value == F.floor(value)) & value.between(1900, 2100) & text.rlike(YEARS), "calendar_year")
        for name, p in DIMENSIONS.items():
            kind = kind.when(text.rlike(p), name)
        return F.struct(
            F.format_string("N%03d", k + 1).alias("quantity_id"), c["amount"].alias("amount"), value.alias("value"), F.when(offset & unit.rlike(r"(?iuU)таймфрейм|time\s*frame"), None).otherwise(unit).alias("unit"),
            F.coalesce(_said(q["entity"]), F.when(offset, "window_index")).alias("entity"), F.coalesce(_said(q["role"]), F.when(offset, "index_offset")).alias("role"),
            F.coalesce(q["dimension"], kind.otherwise("count")).alias("dimension"), F.coalesce(q["metric_status"], F.when(text.rlike(ROUGHLY), "approximate").otherwise("defined")).alias("metric_status"), c["ids"].alias("evidence_ids"),
        )

    kind = "array<struct<quantity_id:string,amount:string,value:double,unit:string,entity:string,role:string,dimension:string,metric_status:string,evidence_ids:array<string>>>"
    return F.coalesce(F.transform(F.filter(F.transform(raw["quantities"], cite), borne_out), made), F.array().cast(kind))


def clauses(evidence: Column, owner: Column) -> Column:
    """What the owner's own turns say they do: a clause for each action verb, with its object.

    A verb whose subject is "we" makes none; verbs joined by "or" make one; an object may stand before its verb.
    """
    mark = "\u0001"

    def of_turn(t: Column) -> Column:
        text = F.coalesce(t["text"], F.lit(""))
        marked = F.regexp_replace(F.regexp_replace(text, "(?iuU)(" + ONSET + "?)(?=\\b[а-яё-]+(?:ть|ти)\\b)", "$1" + mark), r"(?iuU)(?=\b" + VERBS + r"\b)", mark)
        parts = F.split(F.concat(F.lit(" "), marked), mark + "+")

        # groups of parts: what is before the verb, and from it to the next; a part that opens no clause goes on with the one before
        def step(acc: Column, part: Column) -> Column:
            last = F.element_at(acc, -1)
            before = F.concat(last["before"], last["frame"])
            team = F.regexp_extract(before, r"[^.!?;,\n]*$", 0).rlike(r"(?iuU)\bмы\b[^.!?;]{0,40}$")
            either = (last["frame"] != "") & last["tail"].rlike(r"(?iuU)\b(?:или|либо)\b")
            first = last["frame"] == ""
            longer = F.struct(
                F.when(first, F.concat(last["before"], part)).otherwise(last["before"]).alias("before"), F.when(first, "").otherwise(F.concat(last["frame"], part)).alias("frame"),
                F.when(first, "").when(team, F.concat(last["tail"], part)).otherwise(part).alias("tail"),
            )
            new = F.struct(before.alias("before"), part.alias("frame"), part.alias("tail"))
            return F.when(team | either, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

        start = F.array(F.struct(F.get(parts, F.lit(0)).alias("before"), F.lit("").alias("frame"), F.lit("").alias("tail")))
        groups = F.filter(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), start, step), lambda g: g["frame"] != "")
        tense = F.when(text.rlike(PAST), "past_attempt").when(text.rlike(PROGRESS), "in_progress").otherwise("planned")
        bound = F.when(text.rlike(TRY), "intent_to_attempt").when(text.rlike(PROMISE), "explicit_commitment").otherwise("unknown")

        def clause(g: Column) -> Column:
            predicate = F.regexp_extract(g["frame"], r"(?U)^[\w-]+", 0)
            lead = F.trim(F.regexp_extract(g["before"], r"[^.!?;\n]*$", 0), F.lit(EDGES))
            lead = F.trim(F.regexp_replace(F.regexp_replace(lead, LEADING, " "), r"\s+", " "), F.lit(EDGES))
            lead = F.when((F.size(F.split(lead, " ")) > 5) | lead.rlike(r"(?iuU)\b" + VERBS + r"\b"), "").otherwise(lead)
            rest = F.trim(F.regexp_replace(g["frame"], TRAILING, ""), F.lit(EDGES))
            rest = F.trim(F.substring(rest, F.length(predicate) + 1, F.length(rest)), F.lit(EDGES[:-1]))
            rest = F.trim(F.get(F.split(rest, NEXT_SUBJECT, 2), F.lit(0)), F.lit(EDGES[:-1]))
            near = F.concat(F.right(g["before"], F.lit(60)), g["frame"])
            return F.struct(
                owner.alias("actor"), predicate.alias("predicate"), _said(F.concat_ws(" ", F.nullif(lead, F.lit("")), F.nullif(rest, F.lit("")))).alias("object"), near.rlike(r"(?iuU)\bпараллельно\b").alias("parallel"),
                tense.alias("temporal_state"), bound.alias("commitment_state"), F.array_compact(F.array(t["id"])).alias("evidence_ids"),
            )

        return F.transform(groups, clause)

    return F.flatten(F.transform(F.filter(evidence, lambda t: t["speaker"] == owner), of_turn))


def actions(f: DataFrame) -> DataFrame:
    """Adds ``actions``: those of ``raw`` whose cited turns have their actor, recipient and object, then the owner's own clauses that none of them covers."""
    past, progress, promise = (F.col(f"own.{x}") for x in ("past", "progress", "promise"))
    stems = lambda t: F.array_distinct(F.transform(S.tokens(t), lambda x: F.substring(x, 1, 5)))

    def proven(a: Column, k: Column) -> Column:
        ids = _within(a["evidence_ids"], F.col("evidence_ids"))
        return F.struct(a.alias("a"), k.alias("k"), ids.alias("ids"), _cited(F.col("evidence"), ids).alias("text"), F.filter(F.col("evidence"), lambda e: F.array_contains(ids, e["id"])).alias("turns"))

    def made(c: Column) -> Column:
        a, text = c["a"], c["text"]
        actor, recipient, thing = _said(a["actor"]), _said(a["recipient"]), _said(a["object"])
        there = F.size(F.array_intersect(stems(thing), stems(text))) / F.greatest(F.lit(1), F.size(stems(thing)))
        told = a["temporal_state"].isin(*TEMPORAL[:-1])
        when = F.when(past, "past_attempt").when(progress, "in_progress").when(promise, "planned").otherwise("unknown")
        bound = F.when(a["commitment_state"].isin(*COMMITMENTS), a["commitment_state"]).otherwise("unknown")
        bound = F.when(past, "none").when(progress, bound).when(promise, "explicit_commitment").when(told, "unknown").otherwise(bound)
        return F.struct(
            F.format_string("A%02d", c["k"] + 1).alias("action_id"), F.when(text.contains(actor) | F.exists(c["turns"], lambda e: e["speaker"] == actor), actor).alias("actor"), F.trim(a["predicate"]).alias("predicate"),
            F.when((F.size(stems(thing)) == 0) | (there >= 0.8), thing).alias("object"), F.when(text.contains(recipient), recipient).alias("recipient"), F.coalesce(a["parallel"], F.lit(False)).alias("parallel"), when.alias("temporal_state"), bound.alias("commitment_state"), c["ids"].alias("evidence_ids"),
        )

    kind = "array<struct<action_id:string,actor:string,predicate:string,object:string,recipient:string,parallel:boolean,temporal_state:string,commitment_state:string,evidence_ids:array<string>>>"
    kept = F.filter(F.transform(F.coalesce("raw.actions", F.array()), proven), lambda c: (F.size(c["ids"]) > 0) & (F.coalesce(F.trim(c["a"]["predicate"]), F.lit("")) != ""))
    f = f.withColumn("_actions", F.coalesce(F.transform(kept, made), F.array()).cast(kind))
    one = F.when(F.size("owners") == 1, F.col("owners")[0])
    whole = F.struct(
        F.lit("A01").alias("action_id"), one.alias("actor"), F.trim(F.coalesce(F.nullif(F.col("raw.predicate"), F.lit("")), F.col("statement"))).alias("predicate"), _said(F.col("raw.object")).alias("object"), F.lit(None).cast("string").alias("recipient"), F.lit(False).alias("parallel"),
        F.when(F.col("speech_act").isin("commit", "propose"), "planned").otherwise("unknown").alias("temporal_state"), F.when(promise & (F.size("owners") == 1), "explicit_commitment").otherwise("unknown").alias("commitment_state"), F.col("evidence_ids").alias("evidence_ids"),
    )
    f = f.withColumn("_actions", F.when((F.size("_actions") == 0) & F.col("own.work"), F.array(whole).cast(kind)).otherwise(F.col("_actions")))
    f = f.withColumn("_clauses", F.when(F.size("owners") == 1, clauses(F.col("evidence"), F.col("owners")[0])).otherwise(F.array()).cast(f"array<struct<{CLAUSE.replace(' ', ':').replace(',:', ',')}>>"))

    # each action takes the first free clause of the same first five letters; an opaque name takes the clause at its own place
    def take(acc: Column, a: Column) -> Column:
        free = lambda c, k: ~F.array_contains(acc["taken"], k)
        places = F.transform(F.col("_clauses"), lambda c, k: F.when(free(c, k) & (F.substring(F.lower(c["predicate"]), 1, 5) == F.substring(F.lower(a["predicate"]), 1, 5)), k))
        n = F.size(acc["out"])
        at = F.coalesce(F.array_min(places), F.when(a["predicate"].rlike(INTERNAL) & (n < F.size("_clauses")), n))
        c = F.get(F.col("_clauses"), at)
        joined = a.withField("predicate", F.coalesce(c["predicate"], a["predicate"])).withField("object", F.coalesce(a["object"], c["object"])).withField("actor", F.coalesce(a["actor"], c["actor"]))
        joined = joined.withField("parallel", a["parallel"] | F.coalesce(c["parallel"], F.lit(False))).withField("evidence_ids", F.array_distinct(F.concat(a["evidence_ids"], F.coalesce(c["evidence_ids"], _none()))))
        return F.struct(F.concat(acc["out"], F.array(F.struct(joined.alias("a"), at.isNotNull().alias("met")))).alias("out"), F.when(at.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(at))).alias("taken"))

    start = F.struct(F.array().cast(f"array<struct<a:{kind[6:-1]},met:boolean>>").alias("out"), F.array().cast("array<int>").alias("taken"))
    f = f.withColumn("_met", F.aggregate("_actions", start, take))
    left = F.filter("_met.out", lambda x: x["met"] | ~x["a"]["predicate"].rlike(INTERNAL) | (F.size("_clauses") == 0))
    f = f.withColumn("_left", F.transform(left, lambda x: x["a"]))
    more = F.filter(F.transform("_clauses", lambda c, k: F.when(~F.array_contains("_met.taken", k) & (F.size(c["evidence_ids"]) > 0), c)), lambda c: c.isNotNull())
    row = lambda c, k: F.struct(F.format_string("A%02d", F.size("_left") + k + 1).alias("action_id"), c["actor"], c["predicate"], c["object"], F.lit(None).cast("string").alias("recipient"), c["parallel"], c["temporal_state"], c["commitment_state"], c["evidence_ids"])
    return f.withColumn("actions", F.concat("_left", F.transform(more, row).cast(kind))).drop("_actions", "_clauses", "_met", "_left")


def speech_act(f: DataFrame) -> DataFrame:
    """Adds speech_act: that of the statement, where only the owner's own turn makes a promise; else of the fact's type, else the model's."""
    said, kind = S.primary_speech_act("statement"), F.col("type")
    said = F.when(F.col("own.promise"), "commit").when(said == "commit", F.when(kind.isin("action", "proposal", "follow_up"), "propose").otherwise("assert")).otherwise(said)
    f = f.withColumn("_act", said)
    typed = F.when(F.col("_act") != "assert", F.col("_act")).when(kind == "question", "ask").when(kind == "proposal", "propose").when(kind == "decision", "decide").otherwise("assert")
    f = f.withColumn("_act", typed)
    model = F.col("raw.speech_act")
    f = f.withColumn("_act", F.when((F.col("_act") == "assert") & model.isin(*ACTS) & ((model != "commit") | F.col("own.statement")), model).otherwise(F.col("_act")))
    asks = F.exists("evidence", lambda e: (e["speaker"] == F.col("owners")[0]) & e["text"].contains("?") & (e["text"].rlike(OWN_TASK) | e["text"].rlike(r"(?iuU)\b" + VERBS + r"\b")))
    proposal = kind.isin("action", "follow_up") & (F.size("owners") == 1) & F.coalesce(asks, F.lit(False))
    return f.withColumn("speech_act", F.when(proposal & F.col("_act").isin("assert", "answer", "ask", "commit"), "propose").otherwise(F.col("_act"))).drop("_act")


def normalize_records(facts: DataFrame) -> DataFrame:
    """One semantic record for each fact; columns of the fact that are not of the record go."""
    kind, statement = F.col("type"), F.coalesce(F.col("statement"), F.lit(""))
    f = speech_act(owners(facts.withColumn("evidence_ids", _list(F.col("evidence_ids"))).withColumn("statement", statement)))
    f = actions(f)
    raw, ids, ev = F.col("raw"), F.col("evidence_ids"), F.col("evidence")
    answers = _within(raw["answer_evidence_ids"], ids)
    f = f.withColumn("answer_evidence_ids", answers).withColumn("conditions", conditions(raw, ids)).withColumn("quantities", quantities(raw, ids, ev))
    about = F.when(kind != "question", "not_applicable").when(statement.rlike(OF_TRANSCRIPT) & ~statement.rlike(OF_DISCUSSION), "transcript_verification").otherwise("discussion")
    open_ = (F.coalesce(raw["question_status"], F.lit("")) == "unresolved") | statement.rlike(UNRESOLVED)
    within = F.size("answer_evidence_ids") > 0
    status = F.when(kind != "question", "not_applicable").when(within, "resolved").when(open_, "unresolved").when(statement.rlike(RESOLVED), "resolved").otherwise("unclear")
    basis = F.when(kind != "question", None).when(within, "within_fact_evidence").when(open_, None).when(statement.rlike(RESOLVED), "within_fact_statement")
    own, n = F.col("own"), F.size("owners")
    assigned = F.when(~(own["work"] | own["lifecycle"]), "not_applicable").when((n > 0) & (F.size("confirmation_evidence_ids") > 0), "confirmed").when(n > 0, "unconfirmed").otherwise("unknown")
    f = f.withColumn("question_kind", about).withColumn("question_status", status).withColumn("answer_resolution_basis", basis).withColumn("assignment_status", assigned)
    text = F.array_join(F.transform("evidence", lambda e: F.coalesce(e["text"], F.lit(""))), " ")
    source_time = F.nullif(F.regexp_extract(text, AFTER_ZERO, 0), F.lit(""))
    f = f.withColumn("_text", text).withColumn("time_expression", F.coalesce(source_time, _said(raw["time_expression"])))
    unclear = F.coalesce(F.col("time_expression").rlike(AFTER_ZERO) & raw["timezone"].isNull(), F.lit(False))
    known = F.lower(F.concat_ws(" ", "topic", "entities"))
    terms = F.filter(F.regexp_extract_all("statement", F.lit(r"(?U)\b[A-Z][A-Za-z-]{2,}(?:\s+[A-Z][A-Za-z-]{1,})+\b"), F.lit(0)), lambda t: ~F.contains(known, F.lower(t)))
    f = f.withColumn("ambiguous_clock", unclear).withColumn("unresolved_terms", F.array_sort(F.array_distinct(terms)))
    doubt = (F.col("ambiguous_clock") & kind.isin("action", "schedule", "system_rule", "trading_rule")) | ((F.size("unresolved_terms") > 0) & kind.isin("decision", "proposal", "design_choice", "system_rule", "trading_rule"))
    support = F.coalesce("verification_status", F.lit("supported"))
    modality = F.when(raw["modality"].isin(*MODALITIES), raw["modality"]).when(F.col("certainty") == "tentative", "tentative").otherwise("asserted")
    ruled = ~F.col("speech_act").isin("ask", "commit", "accept", "reject") & ~kind.isin("action", "follow_up", "question", "schedule") & F.col("statement").rlike(RULE)
    promised = own["promise"] & (n == 1)
    slots = lambda c: F.array_distinct(F.filter(_list(c), lambda s: F.trim(s) != ""))
    f = f.withColumn("modality", modality)
    return f.select(
        *[c for c in facts.columns if c not in ("raw", "type", "evidence", "owner_refs", "certainty", "verification_status", "entities", "speaker_refs", "fact_id", "evidence_ids", "statement", "topic", "start")],
        F.col("fact_id").alias("record_id"), kind.alias("kind"), F.coalesce("topic", F.lit("Прочее")).alias("topic"), "statement", F.coalesce("start", F.lit(0.0)).alias("start"), "modality", modality_axis(F.col("modality"), F.col("certainty")).alias("modality_axis"),
        F.when(raw["polarity"] == "negative", "negative").otherwise("positive").alias("polarity"), F.when(ruled, "system_rule").otherwise(F.coalesce(raw["content_kind"], content_kind(kind))).alias("content_kind"), "speech_act",
        F.coalesce(F.nullif(F.col("_text"), F.lit("")), F.col("statement")).rlike(S.CORRECTION).alias("revision_cue"), "conditions", "quantities", "time_expression",
        F.when(F.col("ambiguous_clock"), "ambiguous_clock").when(F.col("time_expression").isNotNull(), "source_raw").otherwise("not_provided").alias("time_status"), "unresolved_terms", F.col("speaker_refs").alias("attributed_speakers"), "proposed_by",
        F.col("owners").alias("assignees"), "assignment_status", "confirmation_evidence_ids", F.when(promised, "explicit").when(F.col("speech_act") == "commit", "implicit").otherwise("none").alias("commitment_strength"),
        F.when(promised, F.col("owners")[0]).alias("commitment_actor"), F.when(F.size("proposed_by") == 1, F.col("proposed_by")[0]).alias("assignment_actor"), F.when(n == 1, F.col("owners")[0]).alias("assignment_target"),
        "question_kind", "question_status", "answer_resolution_basis", "answer_evidence_ids", F.array_distinct(F.filter(_list(raw["answer_record_ids"]), lambda x: x.startswith("F") & (x != F.col("fact_id")))).alias("answer_record_ids"),
        slots(raw["requested_slots"]).alias("requested_slots"), slots(raw["answered_slots"]).alias("answered_slots"), "actions", "evidence_ids", (~F.col("assignment_status").isin("not_applicable", "confirmed")).alias("needs_review"),
        F.when((support == "supported") & doubt, "insufficient_evidence").otherwise(support).alias("verification_status"),
    )
