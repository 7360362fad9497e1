"""Queries of scalar functions and text metrics: fixed phrases dealt over all conversations, numbers of all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import dialogue as D
from .operators import evaluation as E
from .operators import facts as X
from .registry import query, re2, table

PHRASES = (
    "Да, согласен", "Я подготовлю отчёт до пятницы", "Мы решили оставить версию 2", "Предлагаю проверить гипотезу на 15 серверах", "Нет", "Кто отвечает за релиз?", "угу, ладно",
    "Вместо 10:30 встречаемся в 11:00", "Возможно, фильтр улучшит качество", "The GPU4 cluster has 12,5 TB, see @ops", "спасибо", "Работаю 3 месяца без ошибок",
    "Нужно проверить результат 2024-01-15_final", "понятно, делаем", "Ну ладно, дальше",
)
N = len(PHRASES)


def phrase(n: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, PHRASES)), F.pmod(n, F.lit(N)).cast("int"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text t, with a phrase (number i) put before it that rules of Russian speech can tell; every fourth turn is a short reply, the phrase alone.

    o is the text with another phrase.
    """
    i = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(N)).cast("int")
    short = F.pmod("turn", F.lit(4)) == 3
    with_text = lambda p: F.when(short, p).otherwise(F.concat_ws(". ", p, "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", i.alias("i"), with_text(phrase(i)).alias("t"), with_text(phrase(i + 3)).alias("o"))


LIST = "[" + ", ".join(f"'{p}'" for p in PHRASES) + "]"
SAID = f"""SELECT conv_id, turn, role, i, CASE WHEN turn % 4 = 3 THEN p ELSE concat_ws('. ', p, text) END AS t, CASE WHEN turn % 4 = 3 THEN q ELSE concat_ws('. ', q, text) END AS o
FROM (SELECT *, ({LIST})[i + 1] AS p, ({LIST})[(i + 3) % {N} + 1] AS q FROM (SELECT *, ((conv_id * 7 + turn * 3) % {N})::INTEGER AS i FROM conversations))"""
FOLD = "replace(lower({}), 'ß', 'ss')"
SQUEEZED = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_%]+', ' ', 'g'))"
TOKENS = "list_distinct(list_filter(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-zа-яё0-9]+'), lambda x: length(x) > 2))"
NEGATES = "regexp_matches(lower({}), '(^|[^\\p{{L}}\\p{{N}}_])(не|нет|нельзя|никогда|без)([^\\p{{L}}\\p{{N}}_]|$)')"
text = lambda column: f"array_to_string({column}, ',')"


def matches(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {re2(pattern)})"


def acts_sql(t: str) -> str:
    """All speech acts of a text as a list."""
    found = ", ".join(f"CASE WHEN {matches(f'trim({t})', p)} THEN '{a}' END" for a, p in S.ACTS.items())
    return f"(CASE WHEN len(list_filter([{found}], lambda x: x IS NOT NULL)) > 0 THEN list_filter([{found}], lambda x: x IS NOT NULL) WHEN {matches(f'trim({t})', S.ANSWER)} THEN ['answer'] ELSE ['assert'] END)"


def first_act_sql(acts: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains({acts}, '{a}') THEN '{a}'" for a in S.ACT_ORDER) + " ELSE 'assert' END"


SIMILAR = "len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))::DOUBLE"
RISKS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {matches('t', p)} THEN '{n}' END" for n, p in S.RISKS.items()) + "], lambda x: x IS NOT NULL))"
FLAT = "trim(regexp_replace(t, '\\s+', ' ', 'g'))"
ANY_MATERIAL = " OR ".join(f"contains({FOLD.format('t')}, '{w}')" for w in X.MATERIAL)
ANSWER_TYPE = "CASE " + " ".join(f"WHEN {matches(chr(39) + 'x ' + chr(39) + ' || lower(t)', p)} THEN '{n}'" for n, p in D.ANSWER_TYPES.items()) + " ELSE 'free_text' END"
LENGTH = "'(?i)([0-9]+\\s*[—–-]\\s*)?(?:^|[^\\p{L}\\p{N}_])([0-9]{1,6})\\s*(месяц[\\p{L}]*|недел[\\p{L}]*|день|дня|дней|час[\\p{L}]*|минут[\\p{L}]*|год[\\p{L}]*|лет)(?:$|[^\\p{L}\\p{N}_])'"
UNITS = {"месяц": "месяц", "недел": "неделя", "дн": "день", "день": "день", "час": "час", "минут": "минута", "год": "год", "лет": "год"}
PLURAL = "CASE " + " ".join(f"WHEN starts_with(u, '{stem}') THEN n || ' ' || CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN '{D.FORMS[unit][0]}' WHEN n % 10 IN (2, 3, 4) AND n % 100 NOT IN (12, 13, 14) THEN '{D.FORMS[unit][1]}' ELSE '{D.FORMS[unit][2]}' END" for stem, unit in UNITS.items()) + " END"


@query(f"""
WITH s AS (SELECT *, {acts_sql("t")} AS a, trim(t) AS said FROM ({SAID})),
r AS (SELECT *, trim(regexp_replace(said, {re2(S.REPLY_START)}, ''), ' ,.!—-') AS rest FROM s),
y AS (SELECT *, {TOKENS.format("rest")} AS x, {TOKENS.format("o")} AS z, {matches("said", S.ACCEPT)} AND NOT {matches("said", S.REPLY_REJECT)} AND NOT contains(said, '?')
  AND len(string_split(trim(regexp_replace({FOLD.format("said")}, '[^a-zа-яё0-9]+', ' ', 'g')), ' ')) <= 10 AS yes FROM r)
SELECT conv_id, turn, array_to_string(a, ',') AS acts, {first_act_sql("a")} AS act, {matches("t", S.BACKCHANNEL)} AND NOT {matches(f"regexp_extract(t, {re2(S.BACKCHANNEL)}, 1)", S.ACCEPTANCE_CLAUSE)} AS backchannel,
  {matches("said", S.ACCEPTANCE_CLAUSE)} OR (yes AND (rest = '' OR {matches("rest", S.OWN_WORK)} OR {matches("rest", S.NEXT_STAGE)} OR {SIMILAR.format(a="x", b="z")} >= 0.12)) AS accepts FROM y
""")
def dialogue_acts(spark, sf_dir):
    """F08 F09 F12 F13."""
    return said(spark, sf_dir).select("conv_id", "turn", F.array_join(S.speech_acts("t"), ",").alias("acts"), S.primary_speech_act("t").alias("act"), S.weak_backchannel("t").alias("backchannel"), S.accepts("t", "o").alias("accepts"))


@query(f"""
WITH s AS (SELECT *, {RISKS} AS k, {TOKENS.format("t")} AS w, regexp_extract(t, {LENGTH}, 1) AS g, TRY_CAST(regexp_extract(t, {LENGTH}, 2) AS INTEGER) AS n, lower(regexp_extract(t, {LENGTH}, 3)) AS u FROM ({SAID}))
SELECT conv_id, turn, trim(t) = '' OR {matches("t", X.NOISE)} AS noise, len(k) > 0 OR length({FLAT}) >= 90 OR (length({FLAT}) >= 28 AND ({ANY_MATERIAL})) AS material,
  {matches("t", X.FALSIFIABLE)} AND NOT {matches("t", X.MALFORMED)} AND len(list_filter(w, lambda x: x <> 'гипотеза')) > 0 AS hypothesis, {ANSWER_TYPE} AS answer_type, array_to_string(k, ',') AS risks,
  CASE WHEN g <> '' OR n IS NULL OR ((starts_with(u, 'год') OR starts_with(u, 'лет')) AND n >= 1900) THEN NULL ELSE {PLURAL} END AS duration
FROM s
""")
def statement_kinds(spark, sf_dir):
    """P02 P18 P19 U02 F06 F20."""
    t = F.col("t")
    return said(spark, sf_dir).select(
        "conv_id", "turn", X.is_noise(t).alias("noise"), X.material("t").alias("material"), X.valid_hypothesis(t).alias("hypothesis"), D.answer_type(F.lit("x"), t).alias("answer_type"),
        F.array_join(S.semantic_risks("t"), ",").alias("risks"), D.duration_scope(t).alias("duration"),
    )


@query(f"""
WITH s AS (SELECT *, {TOKENS.format("t")} AS a, {TOKENS.format("o")} AS b FROM ({SAID}))
SELECT conv_id, turn, {text("list_sort(list_distinct(list_transform(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.'))))")} AS numbers,
  {text("list_sort(list_distinct(list_filter(regexp_extract_all(" + FOLD.format("t") + ", '[a-zа-яё0-9][a-zа-яё0-9_-]*'), lambda x: regexp_matches(x, '[a-zа-яё]') AND regexp_matches(x, '[0-9]'))))")} AS technical,
  {text("list_sort(list_distinct(regexp_extract_all(t, '@[A-Za-zА-Яа-яЁё0-9_]+')))")} AS mentions, {SQUEEZED.format("t")} AS squeezed,
  {text("list_sort(list_transform(a, lambda x: regexp_replace(x[1:5], '[аеёиоуыэюяaeiouy]$', '')))")} AS stems, left(trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), '._'), 100) AS safe,
  len(list_intersect(a, b)) / greatest(1, least(len(a), len(b)))::DOUBLE AS overlap, len(list_intersect(a, b)) / greatest(1, len(b))::DOUBLE AS entailment,
  ({NEGATES.format("t")} <> {NEGATES.format("o")}) AS opposed
FROM s
""")
def text_tokens(spark, sf_dir):
    """F02 F15 F21 F22 F24 F25 F32."""
    aligned = S.alignment("t", "o")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return said(spark, sf_dir).select(
        "conv_id", "turn", joined(S.numeric_tokens("t")).alias("numbers"), joined(S.technical_tokens("t")).alias("technical"), joined(S.mentions("t")).alias("mentions"), S.squeezed("t").alias("squeezed"),
        joined(S.context_stems("t")).alias("stems"), S.safe_name("t").alias("safe"), S.overlap_coefficient(S.tokens("t"), S.tokens("o")).alias("overlap"), aligned["entailment"].alias("entailment"), (aligned["contradiction"] > 0).alias("opposed"),
    )


RULES = (
    {"source": "отчёт", "target": "документ", "policy": "SAFE_EXACT"}, {"source": "GPU4", "target": "GPU-4", "policy": "CONTEXT_REQUIRED", "required_context": ["cluster"]},
    {"source": "документ", "target": "файл", "policy": "CONTEXT_REQUIRED", "required_context": ["пятницы"]}, {"source": "Нет", "target": "Да", "policy": "NEVER_AUTO"},
)


@query(f"""
WITH s AS (SELECT *, turn % 2 = 0 AS unsure FROM ({SAID})),
a AS (SELECT *, replace(t, 'отчёт', 'документ') AS t1, contains(t, 'отчёт') AS c1 FROM s),
b AS (SELECT *, contains(t1, 'GPU4') AND contains(lower(t1), 'cluster') AND unsure AS c2 FROM a),
c AS (SELECT *, CASE WHEN c2 THEN replace(t1, 'GPU4', 'GPU-4') ELSE t1 END AS t2 FROM b),
d AS (SELECT *, contains(t2, 'документ') AND contains(lower(t2), 'пятницы') AND unsure AS c3 FROM c)
SELECT conv_id, turn, CASE WHEN c3 THEN replace(t2, 'документ', 'файл') ELSE t2 END AS text,
  concat_ws(';', CASE WHEN c1 THEN 'отчёт->документ' END, CASE WHEN c2 THEN 'GPU4->GPU-4' END, CASE WHEN c3 THEN 'документ->файл' END) AS operations,
  translate(t, 'аеор', 'aeop') AS mixed,
  array_to_string(list_transform(string_split(translate(t, 'аео', 'aeo'), ' '), lambda w: CASE
    WHEN length(regexp_replace(w, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(w, '[^А-Яа-яЁё]', '', 'g')) > length(regexp_replace(w, '[^A-Za-z]', '', 'g')) THEN translate(w, 'ABCEHKMOPTXaceopxy', 'АВСЕНКМОРТХасеорху')
    WHEN length(regexp_replace(w, '[^А-Яа-яЁё]', '', 'g')) > 0 AND length(regexp_replace(w, '[^A-Za-z]', '', 'g')) > length(regexp_replace(w, '[^А-Яа-яЁё]', '', 'g')) THEN translate(w, 'АВСЕНКМОРТХасеорху', 'ABCEHKMOPTXaceopxy')
    ELSE w END), ' ') AS one_script
FROM d
""")
def text_repairs(spark, sf_dir):
    """U01 F23."""
    made = S.replaced("t", list(RULES), F.pmod("turn", F.lit(2)) == 0)
    return said(spark, sf_dir).select("conv_id", "turn", made["text"].alias("text"), F.array_join(made["operations"], ";").alias("operations"), F.translate("t", "аеор", "aeop").alias("mixed"), S.one_script(F.translate("t", "аео", "aeo")).alias("one_script"))


# a distance stays the same when both sides lose their common end; what is left is put into one letter for each distinct element, as levenshtein counts bytes
LEFT = "list_slice({a}, 1, len({a}) - {k})"
SAME_END = "coalesce(list_position(list_transform(list_zip(list_reverse({a}), list_reverse({b})), lambda z: z[1] IS DISTINCT FROM z[2]), true) - 1, least(len({a}), len({b})))"
LETTERED = "coalesce(array_to_string(list_transform({a}, lambda x: chr(33 + list_position(list_distinct(list_concat({a}, {b})), x)::INTEGER)), ''), '')"
NUMBERS = "list_sort(list_distinct(list_transform(regexp_extract_all({}, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.'))))"


@query(f"""
WITH s AS (SELECT conv_id, turn, {SQUEEZED.format("t")} AS r, {SQUEEZED.format("o")} AS h, {NUMBERS.format("t")} AS rn, {NUMBERS.format("o")} AS hn FROM ({SAID})),
w AS (SELECT *, list_filter(string_split(r, ' '), lambda x: x <> '') AS rw, list_filter(string_split(h, ' '), lambda x: x <> '') AS hw, string_split(replace(r, ' ', ''), '') AS rc, string_split(replace(h, ' ', ''), '') AS hc FROM s),
k AS (SELECT *, {SAME_END.format(a="rw", b="hw")} AS kw, {SAME_END.format(a="rc", b="hc")} AS kc FROM w),
e AS (SELECT *, {LEFT.format(a="rw", k="kw")} AS ra, {LEFT.format(a="hw", k="kw")} AS ha, {LEFT.format(a="rc", k="kc")} AS rb, {LEFT.format(a="hc", k="kc")} AS hb FROM k),
d AS (SELECT *, levenshtein({LETTERED.format(a="ra", b="ha")}, {LETTERED.format(a="ha", b="ra").replace("list_concat(ha, ra)", "list_concat(ra, ha)")}) AS dw, levenshtein({LETTERED.format(a="rb", b="hb")}, {LETTERED.format(a="hb", b="rb").replace("list_concat(hb, rb)", "list_concat(rb, hb)")}) AS dc FROM e)
SELECT conv_id, turn, dw::INTEGER AS distance, dw / greatest(1, len(rw))::DOUBLE AS wer, dc / greatest(1, length(replace(r, ' ', '')))::DOUBLE AS cer, (rn <> hn)::INTEGER AS number_error FROM d
""")
def text_errors(spark, sf_dir):
    """E02 F31."""
    words = lambda c: F.filter(F.split(S.squeezed(c), " "), lambda w: w != "")
    scored = E.text_scores(said(spark, sf_dir).select("conv_id", "turn", "t", "o"), "t", "o")
    return scored.select("conv_id", "turn", E.word_distance(words("t"), words("o")).alias("distance"), "wer", "cer", "number_error")


@query(f"""
WITH s AS (SELECT conv_id, turn, t FROM ({SAID})), k AS (
  SELECT conv_id, turn, t, 'number' AS kind, regexp_replace(t, '([0-9]+)', '9\\1', 'g') AS c FROM s
  UNION ALL SELECT conv_id, turn, t, 'negation', 'не ' || t FROM s
  UNION ALL SELECT conv_id, turn, t, 'modality', regexp_replace(t, '^[Вв]озможно', 'обязательно') FROM s)
SELECT conv_id, turn, kind, c AS corrupted FROM k WHERE c <> t
""")
def hard_negatives(spark, sf_dir):
    """F43."""
    return E.hard_negatives(said(spark, sf_dir).select("conv_id", "turn", "t"), "t").drop("t")


@query("""
WITH v AS (SELECT *, value / 100 AS v, (user_id % 10) / 10.0::DOUBLE AS u FROM events)
SELECT event_id, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms, strptime(strftime(ts, '%d.%m.%Y'), '%d.%m.%Y')::DATE AS day,
  sha256(sha256(props) || chr(0) || event_type) AS fingerprint, event_id % 40 * 180 + 700 > 5000 * 0.72 AS split,
  round(1 / (1 + exp(-greatest(-30, least(30, 0.3 + v * 0.7 + u * -0.2)))), 9) AS calibrated,
  round(1 / (1 + exp(-greatest(-30, least(30, -1.5 + u * 2.2 + v * 2.0 + u * 1.4 + v * 0.08 + u * -1.2 + v * 1.0)))), 9) AS speaker,
  CASE WHEN event_type = 'error' THEN 'conflict_second_pass' WHEN u > 0.7 THEN 'overlap' WHEN v > 0.5 THEN 'low_snr' WHEN event_type = 'purchase' THEN 'session_prototype' WHEN value < 1.5 THEN 'clean_short' ELSE 'clean_long' END AS bucket
FROM v
""")
def scalar_numbers(spark, sf_dir):
    """F03 F33 F34 F35 F40 F41 X10."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value") / 100).withColumn("u", (F.col("user_id") % 10) / 10.0)
    features = {"agreement": "u", "similarity": "v", "margin": "u", "duration": "v", "overlap": "u", "prototype_stability": "v"}
    return e.select(
        "event_id", S.milliseconds("value").alias("ms"), S.meeting_date(F.concat(F.date_format("ts", "dd.MM.yyyy"), F.lit(" meeting"))).alias("day"), S.submission_fingerprint(F.sha2("props", 256), "event_type").alias("fingerprint"),
        S.split_required(F.col("event_id") % 40, F.lit(5000)).alias("split"), F.round(S.calibrated({"a": "v", "b": "u"}, {"a": 0.7, "b": -0.2}, 0.3), 9).alias("calibrated"), F.round(S.speaker_probability(features), 9).alias("speaker"),
        S.voice_bucket("value", F.col("u") > 0.7, F.col("v") > 0.5, F.col("event_type") == "purchase", F.col("event_type") == "error").alias("bucket"),
    )


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
v AS (SELECT vec_id, embedding::DOUBLE[] AS x, e FROM embeddings, q)
SELECT vec_id, round(CASE WHEN len(x) = len(e) AND len(x) > 0 THEN list_dot_product(x, e) / greatest(1e-9, sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(e, e))) ELSE 0 END, 9) AS cosine FROM v
""")
def vector_cosine(spark, sf_dir):
    """F37."""
    v = table(spark, sf_dir, "embeddings")
    first = F.broadcast(v.groupBy().agg(F.min_by("embedding", "vec_id").alias("e")))  # one row
    return v.join(first).select("vec_id", F.round(S.cosine("embedding", "e"), 9).alias("cosine"))
