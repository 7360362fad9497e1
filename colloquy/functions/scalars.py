"""Scalar functions as column expressions; none leaves the JVM.

Regular expressions are matched on lower-cased text or carry ``(?iuU)``, so that
words and word borders work in Cyrillic on every Java version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _text(x: ColumnOrName) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


# ---------------------------------------------------------------- text


def fold(x: ColumnOrName) -> Column:
    """Case folding: lower case with sharp s as ss."""
    return F.replace(F.lower(_text(x)), F.lit("ß"), F.lit("ss"))


def tokens(x: ColumnOrName, longer_than: int = 2) -> Column:
    """Distinct folded runs of Latin or Cyrillic letters and digits longer than ``longer_than``."""
    found = F.regexp_extract_all(fold(x), F.lit("([a-zа-яё0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Jaccard similarity over tokens of more than two characters."""
    return jaccard(tokens(a), tokens(b))


def alignment(premise: ColumnOrName, hypothesis: ColumnOrName, negation: str = r"(?iuU)(?:^|\W)(?:не|нет|нельзя|никогда|без)(?:\W|$)") -> Column:
    """struct(entailment, contradiction, ambiguous): the share of the hypothesis' tokens in the premise, and whether only one of both negates."""
    p, h = tokens(premise), tokens(hypothesis)
    entailment = F.size(F.array_intersect(p, h)) / F.greatest(F.lit(1), F.size(h))
    against = F.when(_text(premise).rlike(negation) != _text(hypothesis).rlike(negation), 1.0).otherwise(0.0)
    return F.struct(entailment.alias("entailment"), against.alias("contradiction"), ((entailment < 0.72) | (against > 0)).alias("ambiguous"))


def squeezed(x: ColumnOrName) -> Column:
    """Folded text with runs of anything but word characters and % as one space."""
    return F.trim(F.regexp_replace(fold(x), "(?U)[^\\w%]+", " "))


def word_equality_key(x: ColumnOrName) -> Column:
    """Folded text without anything but word characters."""
    return F.regexp_replace(fold(x), "(?U)[^\\w]+", "")


def safe_name(x: ColumnOrName) -> Column:
    """Letters, digits and ``-_.`` kept, all else ``_``; stripped of ``._``, at most 100 characters."""
    return F.substring(F.trim(F.regexp_replace(_text(x), "(?U)[^\\p{L}\\p{N}\\-_.]", "_"), F.lit("._")), 1, 100)


def numeric_tokens(x: ColumnOrName) -> Column:
    """Distinct numbers of a text, with decimal comma as point."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_text(x), F.lit("(\\d+(?:[.,]\\d+)?)"), 1), lambda t: F.replace(t, F.lit(","), F.lit("."))))


def technical_tokens(x: ColumnOrName) -> Column:
    """Distinct folded tokens that mix letters and digits."""
    found = F.regexp_extract_all(fold(x), F.lit("([a-zа-яё0-9][a-zа-яё0-9_-]*)"), 1)
    return F.array_distinct(F.filter(found, lambda t: t.rlike("[a-zа-яё]") & t.rlike("[0-9]")))


def mentions(x: ColumnOrName) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(x), F.lit("(@[A-Za-zА-Яа-яЁё0-9_]+)"), 1))


def grounded(statement: ColumnOrName, evidence: ColumnOrName) -> Column:
    """Whether all numbers, technical tokens and mentions of a statement occur in its evidence."""
    return F.reduce(
        F.array(*[F.size(F.array_except(f(statement), f(evidence))) == 0 for f in (numeric_tokens, technical_tokens, mentions)]),
        F.lit(True), lambda a, b: a & b,
    )


def occurrences(text: ColumnOrName, quote: ColumnOrName) -> Column:
    """How often a quote occurs, without overlap."""
    t, q = _text(text), _text(quote)
    return F.when(q == "", 0).otherwise(((F.length(t) - F.length(F.replace(t, q))) / F.greatest(F.lit(1), F.length(q))).cast("int"))


def grounded_offset(text: ColumnOrName, quote: ColumnOrName) -> Column:
    """Offset from 0 of a quote that occurs exactly once, else null."""
    return F.when(occurrences(text, quote) == 1, F.instr(_text(text), _text(quote)) - 1)


def replaced(text: ColumnOrName, rules: list[dict], uncertain: ColumnOrName | None = None) -> Column:
    """Literal replacements in order: struct(text, operations).

    A rule has source, target, policy (SAFE_EXACT, CONTEXT_REQUIRED or NEVER_AUTO) and required_context;
    CONTEXT_REQUIRED needs every context word in the text and an uncertain recognition.
    """
    value, log = _text(text), F.array().cast("array<string>")
    for r in rules:
        policy = r.get("policy", "NEVER_AUTO")
        ok = value.contains(r["source"])
        if policy == "NEVER_AUTO":
            continue
        if policy == "CONTEXT_REQUIRED":
            for word in r.get("required_context", []):
                ok = ok & F.lower(value).contains(word.lower())
            ok = ok & (_c(uncertain) if uncertain is not None else F.lit(False))
        log = F.when(ok, F.array_append(log, F.lit(f"{r['source']}->{r['target']}"))).otherwise(log)
        value = F.when(ok, F.replace(value, F.lit(r["source"]), F.lit(r["target"]))).otherwise(value)
    return F.struct(value.alias("text"), log.alias("operations"))


def context_stems(x: ColumnOrName) -> Column:
    """First five letters of each token, less a final vowel."""
    return F.transform(tokens(x), lambda t: F.regexp_replace(F.substring(t, 1, 5), "[аеёиоуыэюяaeiouy]$", ""))


def one_script(x: ColumnOrName) -> Column:
    """Look-alike letters of a token brought to the script that most of its letters have."""
    # fixed values: letters that look alike in both scripts
    latin, cyrillic = "ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху"

    def one(t: Column) -> Column:
        n_latin = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
        n_cyrillic = F.length(F.regexp_replace(t, "[^А-Яа-яЁё]", ""))
        return F.when((n_latin > 0) & (n_cyrillic > n_latin), F.translate(t, latin, cyrillic)).when((n_cyrillic > 0) & (n_latin > n_cyrillic), F.translate(t, cyrillic, latin)).otherwise(t)

    return F.array_join(F.transform(F.split(_text(x), " "), one), " ")


# ---------------------------------------------------------------- fixed patterns of dialogue

# fixed values: patterns that tell risks and speech acts
CORRECTION = (
    r"(?iuU)(?:\bа\s+нет\b|\bнет\s*[,—-]?\s*(?:подожди|постой)\b|\b(?:точнее|вернее|поправка|исправлюсь)\b|"
    r"\bя\s+(?:ошибся|ошиблась)\b|\bне\s+так\b|\bвместо\b|\bне\s+\S+\s*[,—-]+\s*а\b)"
)
COMMITMENT = (
    r"(?iuU)(?:\bя\b[^.!?\n]{0,100}\b(?:буду|сделаю|проверю|подготовлю|возьму|исправлю|отправлю|пришлю|передам|предоставлю|отдам|скину|кину|дам|залью|"
    r"размечу|протестирую|посмотрю|добавлю|соберу|покажу|встрою)\b|\b(?:сделаю|проверю|подготовлю|"
    r"исправлю|отправлю|пришлю|передам|предоставлю|скину|кину|размечу|протестирую|встрою)\b)"
    r"|\b(?:сделает|проверит|подготовит|исправит|отправит|пришл[её]т|передаст|предоставит|"
    r"разметит|протестирует|покажет|собер[её]т|добавит)\b"
)
DECISION = r"(?iuU)\b(?:решили|решено|договорились|утвердили|фиксируем|оставляем)\b"
PROPOSAL = r"(?iuU)\b(?:предлагаю|можно|давайте|стоит|имеет смысл|я бы)\b"
ACCEPT = (
    r"(?iuU)^\s*(?:(?:да[\s,!.—-]*)+|ага|угу|ок(?:ей)?|соглас(?:ен|на|ны)?|договорились|"
    r"(?:а[\s,]*)?(?:месяца?[\s,.:—-]*)?ну\s+ладно(?:[\s,]*хорошо)?)\W*(?:дальше\b.*)?$"
)
REJECT = r"(?iuU)^\s*(?:нет|неа|не соглас(?:ен|на|ны)?)\W*$"
QUESTION = r"(?iuU)\?|^\s*(?:кто|что|где|когда|почему|как|какой|какая|какие|нужно ли)\b"
ANSWER = r"(?iuU)^\s*(?:да|нет|потому что|это|там|тогда|нужно|надо|можно)\b"
SCHEDULE = (
    r"(?iuU)(?:\b\d{1,2}[:.]\d{2}\b|\b(?:сегодня|завтра|послезавтра|понедельник|вторник|"
    r"сред[ау]|четверг|пятниц[ау]|суббот[ау]|воскресень[ея]|дедлайн|срок|к следующему разу)\b)"
)
RISKS = {
    "agreement": r"(?iuU)^\s*(?:да|ага|угу|ок(?:ей)?|соглас(?:ен|на|ны)?)\W*$",
    "disagreement": r"(?iuU)^\s*(?:нет|неа|не соглас(?:ен|на|ны)?)\W*$",
    "negation": r"(?iuU)(?:^|\W)(?:не|нет|нельзя|никогда|без)(?:\W|$)",
    "quantity": r"(?iuU)(?:\d+(?:[.,:]\d+)*|\b(?:один|два|три|четыре|пять|шесть|семь|восемь|девять|десять)\b)",
    "date_time": SCHEDULE,
    "commitment": COMMITMENT,
    "correction": CORRECTION,
    "question": r"(?iuU)\?|^\s*(?:кто|что|где|когда|почему|как|какой|нужно ли)\b",
}
# fixed values: weights of risks
RISK_WEIGHTS = {
    "agreement": 2, "disagreement": 3, "negation": 3, "quantity": 3, "date_time": 3, "commitment": 4, "correction": 4, "question": 1,
    "asr_boundary": 3, "speaker_inferred": 3, "multiple_speakers": 3,
}
CRITICAL_KINDS = ("decision", "action", "schedule", "metric")
ACTS = {"correct": CORRECTION, "commit": COMMITMENT, "accept": ACCEPT, "reject": REJECT, "ask": QUESTION, "decide": DECISION, "propose": PROPOSAL, "schedule": SCHEDULE}
ACT_ORDER = ("correct", "commit", "decide", "accept", "reject", "ask", "propose", "answer")
# fixed values: kinds of relations
RELATION_KINDS = (
    "supports", "contradicts", "corrects", "clarifies", "refines", "answers", "partially_answers", "tentatively_answers", "rejects", "accepts", "motivates", "causes",
    "depends_on", "alternative_to", "supersedes", "assigns", "accepts_assignment", "creates", "result_of", "tested_by", "explains", "condition_for", "implements",
    "tests", "blocks", "assigned_to", "resolves", "reopens", "qualifies", "confirms", "revises_scope",
)


def semantic_risks(text: ColumnOrName, flags: ColumnOrName | None = None, speakers: ColumnOrName | None = None, patterns: dict[str, str] | None = None) -> Column:
    """Sorted distinct risk names of a text, its flags and speakers."""
    found = [F.when(_text(text).rlike(p), F.lit(name)) for name, p in (patterns or RISKS).items()]
    if flags is not None:
        f = F.coalesce(_c(flags), F.array().cast("array<string>"))
        found.append(F.when(F.arrays_overlap(f, F.array(*map(F.lit, ("asr_boundary", "asr_alternative")))), F.lit("asr_boundary")))
        found.append(F.when(F.arrays_overlap(f, F.array(*map(F.lit, ("ambiguous", "no_diarization", "speaker_context", "speaker_smoothed", "clause_coherence")))), F.lit("speaker_inferred")))
    if speakers is not None:
        found.append(F.when(F.size(F.array_distinct(F.filter(_c(speakers), lambda s: s.isNotNull() & (s != "")))) > 1, F.lit("multiple_speakers")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def risk_level(risks: ColumnOrName, kind: ColumnOrName | None = None, weights: dict[str, int] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (weights or RISK_WEIGHTS).items() for x in kv])
    score = F.aggregate(F.array_distinct(_c(risks)), F.lit(0), lambda acc, r: acc + F.coalesce(F.try_element_at(table, r), F.lit(1)))
    if kind is not None:
        score = score + F.when(_c(kind).isin(*CRITICAL_KINDS), 4).otherwise(0)
    return F.when(score >= 8, "CRITICAL").when(score >= 5, "HIGH").when(score >= 2, "MEDIUM").otherwise("LOW")


def speech_acts(text: ColumnOrName) -> Column:
    t = F.trim(_text(text))
    found = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in ACTS.items()]))
    return F.when(F.size(found) > 0, found).when(t.rlike(ANSWER), F.array(F.lit("answer"))).otherwise(F.array(F.lit("assert")))


def primary_speech_act(text: ColumnOrName, kind: ColumnOrName | None = None) -> Column:
    """The first of a text's acts in order of weight; without one, what its kind says, or an assertion."""
    other = F.lit("assert")
    if kind is not None:
        other = F.when(_c(kind) == "question", "ask").when(_c(kind) == "decision", "decide").when(_c(kind) == "proposal", "propose").when(_c(kind) == "action", "commit").otherwise("assert")
    return F.coalesce(F.get(F.array_intersect(F.array(*map(F.lit, ACT_ORDER)), speech_acts(text)), F.lit(0)), other)


# fixed values: replies that are mere signals, and clauses that accept
BACKCHANNEL = r"(?iuU)^\s*(?:угу|ага|понятно|хорошо|ясно|ладно)\b[\s,!.—-]*(.*)$"
ACCEPTANCE_CLAUSE = r"(?iuU)\b(?:соглас(?:ен|на|ны)|делаем|подтверждаю|принимаю|утверждаю|договорились|так\s+и\s+сделаем)\b"
REPLY_REJECT = r"(?iuU)^\s*(?:нет|не согласен|не делаем|отклоняем)\b"
REPLY_START = r"(?iuU)^\s*(?:(?:да[\s,!.—-]*)+|ок(?:ей)?|(?:а[\s,]*)?(?:месяца?[\s,.:—-]*)?ну\s+ладно)\b"
OWN_WORK = r"(?iuU)^(?:я\s+)?(?:сделаю|возьму|беру|подготовлю|отправлю|передам|выполню|займусь|реализую|проверю|проведу|запущу)\b"
NEXT_STAGE = r"(?iuU)\b(?:дальше|следующ\w*|переходим|этап)\b"


def weak_backchannel(text: ColumnOrName) -> Column:
    """A listener's signal whose rest accepts nothing."""
    t = _text(text)
    return t.rlike(BACKCHANNEL) & ~F.regexp_extract(t, BACKCHANNEL, 1).rlike(ACCEPTANCE_CLAUSE)


def accepts(text: ColumnOrName, target: ColumnOrName, accept: str | None = None) -> Column:
    """Whether a reply accepts its target.

    It does by an acceptance clause, or as a yes of at most ten words without a question, whose rest is empty
    or goes on with own work, the next stage, or the words of the target.
    """
    said = F.trim(_text(text))
    yes = F.struct(said.rlike(accept or ACCEPT).alias("is"), (said.rlike(REPLY_REJECT) | said.contains("?")).alias("not"), F.size(F.split(F.trim(F.regexp_replace(fold(said), "[^a-zа-яё0-9]+", " ")), " ")).alias("words"))
    rest = F.trim(F.regexp_replace(said, REPLY_START, ""), F.lit(" ,.!—-"))
    onwards = F.array((rest == ""), rest.rlike(OWN_WORK), rest.rlike(NEXT_STAGE), similarity(rest, target) >= 0.12)
    return said.rlike(ACCEPTANCE_CLAUSE) | (yes["is"] & ~yes["not"] & (yes["words"] <= 10) & F.exists(onwards, lambda x: x))


# ---------------------------------------------------------------- time, numbers


def milliseconds(seconds: ColumnOrName) -> Column:
    """Whole milliseconds, half to even; null unless finite and not negative."""
    s = _c(seconds).cast("double")
    return F.when((s >= 0) & (s < float("inf")) & ~F.isnan(s), F.bround(s * 1000).cast("bigint"))


def timestamp(seconds: ColumnOrName, srt: bool = False) -> Column:
    """hh:mm:ss.mmm (with a comma for subtitles)."""
    ms = F.greatest(F.lit(0).cast("bigint"), F.bround(_c(seconds).cast("double") * 1000).cast("bigint"))
    return F.format_string("%02d:%02d:%02d" + ("," if srt else ".") + "%03d", F.floor(ms / 3600000), F.floor((ms % 3600000) / 60000), F.floor((ms % 60000) / 1000), ms % 1000)


def meeting_date(name: ColumnOrName) -> Column:
    """The date of a dd.mm.yyyy at the start of a name, else null."""
    return F.try_to_date(F.nullif(F.regexp_extract(_text(name), "^(\\d{2}\\.\\d{2}\\.\\d{4})", 1), F.lit("")), "dd.MM.yyyy")


def input_upper(body: ColumnOrName) -> Column:
    """1.2 tokens for each UTF-8 byte, rounded up."""
    return F.floor((F.octet_length(_text(body)) * 6 + 4) / 5).cast("bigint")


def split_required(items: ColumnOrName, budget: ColumnOrName, per_record: int = 180, schema: int = 700, safety: float = 0.72) -> Column:
    return _c(items) * per_record + schema > _c(budget) * safety


def logistic(z: Column) -> Column:
    """1 / (1 + exp(-z)), z kept within 30 of 0."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def calibrated(features: dict[str, ColumnOrName], coefficients: dict[str, float], intercept: float = 0.0) -> Column:
    z = F.lit(float(intercept))
    for k, w in coefficients.items():
        if k in features:
            z = z + F.coalesce(_c(features[k]).cast("double"), F.lit(0.0)) * w
    return logistic(z)


# fixed values: coefficients of the speaker calibration
SPEAKER_COEFFICIENTS = {"agreement": 2.2, "similarity": 2.0, "margin": 1.4, "duration": 0.08, "overlap": -1.2, "prototype_stability": 1.0}
SPEAKER_BIAS = -1.5


def speaker_probability(features: dict[str, ColumnOrName]) -> Column:
    return calibrated(features, SPEAKER_COEFFICIENTS, SPEAKER_BIAS)


def isotonic(score: ColumnOrName, points: list[tuple[float, float]]) -> Column:
    """The value of the first step at or after the score; the last one's beyond."""
    out = None
    for x, y in sorted(points):
        out = F.when(_c(score) <= x, y) if out is None else out.when(_c(score) <= x, y)
    return out.otherwise(sorted(points)[-1][1]) if out is not None else F.lit(None).cast("double")


def voice_bucket(duration: ColumnOrName, overlap: ColumnOrName, low_snr: ColumnOrName, session_prototype: ColumnOrName, conflict: ColumnOrName) -> Column:
    return F.when(_c(conflict), "conflict_second_pass").when(_c(overlap), "overlap").when(_c(low_snr), "low_snr").when(_c(session_prototype), "session_prototype").when(_c(duration) < 1.5, "clean_short").otherwise("clean_long")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """struct(precision, recall, f1) with guarded denominators."""
    p, r = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)
    return F.struct(p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(F.lit(1e-12), p + r)).alias("f1"))


# ---------------------------------------------------------------- hashes, vectors


def stable_id(prefix: str, canonical: ColumnOrName) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(_c(canonical), 256), 1, 16))


def submission_fingerprint(digest: ColumnOrName, name: ColumnOrName) -> Column:
    return F.sha2(F.concat_ws("\u0000", _c(digest), _text(name)), 256)


def canonical_json(fields: dict[str, ColumnOrName]) -> Column:
    """JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*[_c(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product in double precision; -1 if lengths differ."""
    x, y = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    s = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(x) == F.size(y), s).otherwise(F.lit(-1.0))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine; 0 for empty vectors or differing lengths."""
    x, y = _c(a).cast("array<double>"), _c(b).cast("array<double>")
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), dot(x, y) / F.greatest(F.lit(1e-9), norm)).otherwise(F.lit(0.0))
