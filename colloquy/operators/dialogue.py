"""Dialogue operators: evidence spans, centroids, entities, tasks, replies, answer types, redaction, budgets."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import intervals
from .sequence import Episodes, Fold, fold

# fixed values: answer types and the words that tell them, in order
ANSWER_TYPES = {
    "boolean": r"(?iuU)\b(?:yes.?no|boolean|ли|should|whether|возможн\w*|решени\w*|closing|feasibility)\b",
    "entity": r"(?iuU)\b(?:кто|кому|чей|actor|owner|assignee|исполнител\w*)\b",
    "time": r"(?iuU)\b(?:когда|врем\w*|день|дат\w*|time|schedule|closing)\b",
    "quantity": r"(?iuU)\b(?:сколько|числ\w*|количеств\w*|порог\w*|размер\w*|quantity|number|threshold|range)\b",
    "explanation": r"(?iuU)\b(?:почему|зачем|причин\w*|объясн\w*|reason|explanation)\b",
    "implementation_state": r"(?iuU)\b(?:статус|готов\w*|реализ\w*|работа\w*|результат\w*|implementation|state|status|result|success)\b",
    "action_choice": r"(?iuU)\b(?:что\s+делать|какой\s+вариант|действи\w*|commitment|choice|next step)\b",
}
# fixed values: modality by value
MODALITY = {
    "asserted": "certain", "committed": "certain", "question": "possible", "proposed": "possible", "tentative": "speculative", "conditional": "conditional",
    "certain": "certain", "probable": "probable", "possible": "possible", "speculative": "speculative",
}
# fixed values: Russian plural forms
FORMS = {"месяц": ("месяц", "месяца", "месяцев"), "неделя": ("неделя", "недели", "недель"), "день": ("день", "дня", "дней"), "час": ("час", "часа", "часов"), "минута": ("минута", "минуты", "минут"), "год": ("год", "года", "лет")}
# fixed values: parts of keys whose values are masked, and keys that only measure
SENSITIVE = ("password", "passwd", "secret", "token", "authorization", "cookie", "api_key", "statement", "utterance", "prompt", "transcript", "raw_text", "source_text", "dialogue_evidence")
TELEMETRY = (
    "utterances", "utterance_count", "transcript_sha256", "audio_sha256", "worker_sha256", "config_sha256", "prompt_sha256", "system_sha256", "request_key", "prompt_eval_duration", "eval_duration", "load_duration",
    "total_duration", "prompt_eval_count", "eval_count", "prompt_tokens", "output_tokens", "system_chars", "prompt_chars", "tokens",
)


def answer_type(slot: Column, question: Column) -> Column:
    value = F.regexp_replace(F.trim(F.lower(F.coalesce(slot, F.lit("")))), "[_\\s]+", " ")
    source = F.concat_ws(" ", value, F.lower(F.coalesce(question, F.lit(""))))
    out = F.when(value.isin(*ANSWER_TYPES, "free_text"), value)
    for name, pattern in ANSWER_TYPES.items():
        out = out.when(source.rlike(pattern), name)
    return out.otherwise("free_text")


def modality_axis(value: Column, certainty: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MODALITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), F.when(certainty == "tentative", "speculative").otherwise("certain"))


def plural(n: Column, unit: str) -> Column:
    """A count with the form of its unit."""
    one, few, many = FORMS[unit]
    a, b = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.concat_ws(" ", n.cast("string"), F.when((a == 1) & (b != 11), one).when(a.isin(2, 3, 4) & ~b.isin(12, 13, 14), few).otherwise(many))


def duration_scope(text: Column) -> Column:
    """``n unit`` of the first duration in digits; null without one, for ranges and for years as dates."""
    stems = {"месяц": "месяц", "недел": "неделя", "дн": "день", "день": "день", "час": "час", "минут": "минута", "год": "год", "лет": "год"}
    pattern = "(?iuU)(\\d+\\s*[—–-]\\s*)?\\b(\\d{1,6})\\s*(месяц\\w*|недел\\w*|день|дня|дней|час\\w*|минут\\w*|год\\w*|лет)\\b"
    rng, n, unit = (F.regexp_extract(F.coalesce(text, F.lit("")), pattern, k) for k in (1, 2, 3))
    found = F.struct(rng.alias("range"), F.try_to_number(n, F.lit("999999")).cast("int").alias("n"), F.lower(unit).alias("unit"))

    def scope(x: Column) -> Column:
        out = F.when((x["range"] != "") | x["n"].isNull(), F.lit(None).cast("string")).when(x["unit"].rlike("^(год|лет)") & (x["n"] >= 1900), F.lit(None).cast("string"))
        for stem, name in stems.items():
            out = out.when(x["unit"].startswith(stem), plural(x["n"], name))
        return out

    return F.get(F.transform(F.array(found), scope), F.lit(0))  # what was found is worked out once


def evidence_spans(utterances: DataFrame, words: DataFrame, keys: Sequence[str], width: float = 10.0) -> DataFrame:
    """Sentences of each utterance from the words of its speaker that touch it: (keys, utterance_id, span, start, end, word_ids, text).

    utterances: utterance_id, start, end, speaker; words: pos, word_id, text, start, end, speaker.
    """
    pairs = intervals.interval_join(utterances.select(*keys, "utterance_id", "start", "end", "speaker"), words.select(*keys, "pos", "word_id", "text", "start", "end", "speaker"), keys, width, closed=True).where(F.col("speaker").eqNullSafe(F.col("r_speaker")))
    w = Window.partitionBy(*keys, "utterance_id").orderBy("r_pos")
    ends = F.when(F.rtrim("r_text").rlike("[.?!…]$"), 1).otherwise(0)
    pairs = pairs.withColumn("span", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = F.array_sort(F.collect_list(F.struct("r_pos", "r_word_id", "r_text")))
    return pairs.groupBy(*keys, "utterance_id", "span").agg(F.min("r_start").alias("start"), F.max("r_end").alias("end"), F.transform(rows, lambda x: x["r_word_id"]).alias("word_ids"), F.array_join(F.transform(rows, lambda x: x["r_text"]), " ").alias("text"))


SIMILARITIES = 1 << 24  # that one task holds when it looks for a medoid


class _Tile:
    """Some vectors of a group, each against all ``n`` of the group, which pass in any order once these are known."""

    def __init__(self, n: int) -> None:
        self.n, self.at, self.own, self.rows = n, 0, {}, None

    def add(self, x: np.ndarray, own: np.ndarray) -> None:
        for v in x[own]:
            held = self.own.setdefault(v.tobytes(), [v, 0])
            held[1] += 1
        if not own.all():
            self.settle()
            self.meet(x[~own])

    def settle(self) -> None:
        if self.rows is None:
            self.rows = np.array([v for v, _ in self.own.values()])
            self.near = np.empty((len(self.rows), self.n))
            self.meet(self.rows, np.repeat(np.arange(len(self.rows)), [k for _, k in self.own.values()]))

    def meet(self, x: np.ndarray, places: np.ndarray | None = None) -> None:
        places = np.arange(len(x)) if places is None else places
        for k in range(0, len(places) if len(self.rows) else 0, 1024):
            some = x[places[k : k + 1024]]
            np.round(self.rows @ some.T, 12, out=self.near[:, self.at : self.at + len(some)])
            self.at += len(some)

    def best(self) -> tuple[float, list[float]] | None:
        """What sorts first for the highest median, and its vector."""
        self.settle()
        if not len(self.rows):
            return None
        self.near.partition(self.n // 2, axis=1)
        rank = -np.nan_to_num(self.near[:, self.n // 2], nan=np.inf)
        first = self.rows[rank == rank.min()]
        return float(rank.min()), first[np.lexsort(first.T[::-1])[0]].tolist()


def _medoids(df: DataFrame, keys: Sequence[str], vector: str, n: str) -> DataFrame:
    """(keys, medoid) of groups of ``n`` vectors: the one whose median likeness to all is highest.

    A group is cut into so many tiles that each holds about SIMILARITIES; a tile's vectors come first, then the others stream by.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = T._parse_datatype_string(f"{fields}, _rank double, medoid array<double>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        now, tile = None, None

        def done() -> Iterable[pa.RecordBatch]:
            if tile is not None and (got := tile.best()) is not None:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*now[:-1], *got), strict=True))], schema=arrow)

        for b in batches:
            # one object stands for all NaN, which equals itself then
            ids = list(zip(*[[math.nan if x != x else x for x in b.column(c).to_pylist()] for c in (*keys, "_tile")], strict=True))
            own, at = b.column("_own").to_numpy(zero_copy_only=False), 0
            for key, same in itertools.groupby(ids):
                end = at + sum(1 for _ in same)
                if tile is None or key != now:
                    yield from done()
                    now, tile = key, _Tile(b.column("_n")[at].as_py())
                x = b.column("_v").slice(at, end - at).flatten().to_numpy().astype(float).reshape(end - at, -1)
                tile.add(x / np.sqrt((x * x).sum(1, keepdims=True)), own[at:end])
                at = end
        yield from done()

    tiles = F.greatest(F.lit(1), F.ceil(F.col(n).cast("double") * F.col(n) / SIMILARITIES)).cast("long")
    dealt = df.select(*keys, F.col(n).alias("_n"), F.col(vector).alias("_v"), F.pmod(F.xxhash64(vector), tiles).alias("_home"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("_tile"))
    dealt = dealt.select(*keys, "_tile", (F.col("_home") == F.col("_tile")).alias("_own"), "_n", "_v").repartition(*[F.col(k) for k in keys], "_tile")
    found = dealt.sortWithinPartitions(*keys, "_tile", F.desc("_own")).mapInArrow(run, schema)
    return found.groupBy(*keys).agg(F.min(F.struct("_rank", "medoid"))["medoid"].alias("medoid"))


def robust_centroid(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """The normalised mean without the fifth that is least like the medoid; null without vectors, or if their lengths differ.

    Likeness counts to twelve places; of vectors that tie, the first in order of components is the medoid, and the first goes.
    All of a group are compared, by several tasks if it is large.
    """
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(S.dot(v, v))
    x = df.select(*keys, F.col(vector).alias("_v"), F.when((F.size(v) > 0) & (norm > 1e-8) & ~F.isnan(norm), norm).alias("_norm"))
    sizes = x.groupBy(*keys).agg(F.count("_norm").alias("_n"), F.min(F.when(F.col("_norm").isNotNull(), F.size("_v"))).alias("_a"), F.max(F.when(F.col("_norm").isNotNull(), F.size("_v"))).alias("_b"))

    def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return left.join(named, same, how).drop(*[f"_k{i}" for i in range(len(keys))])

    sound = beside(x.where("_norm is not null"), sizes.where("_a = _b"), "inner")
    scored = beside(sound, _medoids(sound.where("_n >= 5"), keys, "_v", "_n"), "left")  # of fewer than five none goes
    scored = scored.select(*keys, "_n", F.transform(F.col("_v").cast("array<double>"), lambda c: c / F.col("_norm")).alias("_e"), "medoid")
    w = Window.partitionBy(*keys).orderBy(F.rint(S.dot("_e", "medoid") * 1e12), "_e")
    kept = scored.withColumn("_k", F.row_number().over(w)).where("_k > floor(_n / 5)")
    means = kept.select(*keys, F.posexplode("_e").alias("_i", "_c")).groupBy(*keys, "_i").agg(F.avg("_c").alias("_c"))
    one = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_c"))), lambda s: s["_c"]).alias("_c"), F.greatest(F.lit(1e-12), F.sqrt(F.sum(F.col("_c") * F.col("_c")))).alias("_norm"))
    centroids = one.select(*keys, F.transform("_c", lambda c: c / F.col("_norm")).alias("centroid"))
    return beside(sizes.select(*keys), centroids, "left")


def entity_aliases(entities: DataFrame) -> DataFrame:
    """(alias, entity_ids): names and aliases, folded, with every entity that has them.  entities: entity_id, name, aliases."""
    spread = entities.select("entity_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("_a"))
    return spread.select(S.squeezed("_a").alias("alias"), "entity_id").where("alias <> ''").groupBy("alias").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


def resolve_mentions(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions (mention_id, mention, context_ids) with the one entity that has the name, or the one of several that is in the context; else null."""
    j = mentions.withColumn("alias", S.squeezed("mention")).join(aliases, "alias", "left")
    near = F.array_intersect("entity_ids", F.coalesce("context_ids", F.array().cast("array<string>")))
    return j.select("mention_id", F.when(F.size("entity_ids") == 1, F.get("entity_ids", F.lit(0))).when(F.size(near) == 1, F.get(near, F.lit(0))).alias("entity_id"))


class TaskGroups(Fold):
    """Tasks in order of start to groups: the newest that holds a task it revises, has its owners and work, or its owners and words of the first task.

    Groups are looked up by task, by (owners, action, object) and by owners.
    """

    def __init__(self, least: float = 0.55) -> None:
        self.least, self.n = least, 0
        self.of_task: dict[str, int] = {}
        self.of_work: dict[tuple, int] = {}
        self.words: dict[tuple, list[tuple[int, set[str]]]] = {}

    def row(self, r: dict) -> Iterable[dict]:
        owners, words = tuple(sorted(r["assignees"] or ())), Episodes.words(r["text"])
        work = (owners, r["action"], r["object"]) if owners and r["action"] and r["object"] else None
        found = [self.of_task[t] for t in r["revises"] or () if t in self.of_task]
        if work in self.of_work:
            found.append(self.of_work[work])
        if owners:
            found += [n for n, first in self.words.get(owners, ()) if len(words & first) / max(1, min(len(words), len(first))) >= self.least]
        if found:
            group = max(found)
        else:
            group, self.n = self.n, self.n + 1
            self.words.setdefault(owners, []).append((group, words))
            if work:
                self.of_work[work] = group
        self.of_task[r["task_id"]] = group
        return ({"task_id": r["task_id"], "task_group": group},)


def consolidate_tasks(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: the latest confirmed task that no other of the group revises, with all ids and evidence.

    tasks: task_id, start, text, assignees, action, object, revises, status, evidence_ids.
    """
    groups = fold(tasks.select(*keys, "task_id", "start", "text", "assignees", "action", "object", "revises"), keys, ["start", "task_id"], TaskGroups, "task_id string, task_group int")
    t = tasks.join(groups, [*keys, "task_id"])
    gone = t.select(*keys, "task_group", F.explode("revises").alias("task_id")).distinct().withColumn("_gone", F.lit(1))
    t = t.join(gone, [*keys, "task_group", "task_id"], "left")
    sure = F.col("status").isin("self_committed", "accepted", "assigned", "in_progress", "blocked", "completed").cast("int")
    order = F.struct(F.col("_gone").isNull().cast("int").alias("a"), sure.alias("b"), F.col("start").alias("c"), F.size(S.tokens("text")).alias("d"), F.col("task_id").alias("e"))
    best = t.groupBy(*keys, "task_group").agg(F.max_by(F.struct("task_id", "text", "assignees", "status", "start"), order).alias("_t"), F.transform(F.array_sort(F.collect_list(F.struct("start", "task_id"))), lambda x: x["task_id"]).alias("source_task_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))
    return best.select(*keys, F.format_string("TK%05d", F.col("task_group") + 1).alias("group_id"), "_t.*", "source_task_ids", "evidence_ids")


# limits of redacted JSON, by type: how much stays, and what is put behind it
KEPT = {str: (12_000, lambda n: "…[TRUNCATED]"), list: (1_000, lambda n: [{"truncated_items": n}]), dict: (500, lambda n: {})}
DEPTH = 8


def _shortened(v: object) -> object:
    limit, mark = KEPT.get(type(v), (0, None))
    if mark is None or len(v) <= limit:
        return v
    return dict(list(v.items())[:limit]) if isinstance(v, dict) else v[:limit] + mark(len(v) - limit)


def _sensitive(name: str) -> bool:
    return any(m in name.casefold() for m in SENSITIVE)


def _arguments(items: list) -> list[str]:
    """A command line; what follows an option that names a secret is masked."""
    texts = [str(x) for x in items[: KEPT[list][0]]]
    out: list[str] = []
    for t in texts:
        hide = bool(out) and out[-1].startswith("-") and _sensitive(out[-1])
        out.append("[REDACTED]" if hide else t)
    return out


def _masked(pairs: list[tuple[str, object]]) -> dict:
    """An object as the parser meets it: innermost first, so what is below is done already."""
    def one(k: str, v: object) -> object:
        if k.casefold() not in TELEMETRY and _sensitive(k):
            return "[REDACTED]"
        return _arguments(v) if k.casefold() == "command" and isinstance(v, list) else _shortened(v)

    return {k: one(k, v) for k, v in pairs}


def _flattened(root: object) -> object:
    """Everything more than DEPTH levels below the root is replaced by a mark."""
    level = [root]
    for depth in range(DEPTH + 1):
        slots = [(c, k) for c in level if isinstance(c, dict | list) for k in (list(c) if isinstance(c, dict) else range(len(c)))]
        if depth == DEPTH:
            for c, k in slots:
                c[k] = c[k] if c[k] == "[REDACTED]" else "[MAX_DEPTH]"
        level = [c[k] for c, k in slots]
    return root


def redact_json(value: Column) -> Column:
    """JSON text with sensitive keys masked, long texts, lists and maps cut and depth bounded; null where it is no JSON."""

    def number(text: str) -> float | str:
        x = float(text)
        return round(x, 8) if math.isfinite(x) else str(x)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        read = json.JSONDecoder(object_pairs_hook=_masked, parse_float=number, parse_constant=lambda c: str(float(c))).decode
        out = []
        for text in s:
            try:
                out.append(None if text is None else json.dumps(_flattened(_shortened(read(text))), ensure_ascii=False, sort_keys=True))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(value)


def allocate_outputs(bodies: DataFrame, key: str, available: int, future_items: int, future_tokens: int, prompt_usd: float, completion_usd: float, request_usd: float, longest: int, context: int) -> DataFrame:
    """Bodies (job, body) with their output cap in tokens: what money is left after all inputs, shared by open items; null for a job without room.

    Amounts are whole micro-USD; prices are exact decimals.
    """
    price = lambda x: F.lit(f"{x:.18f}").cast("decimal(38,18)")
    million = F.lit(1_000_000).cast("decimal(20,0)")
    cost = lambda tokens: F.ceil(tokens.cast("decimal(20,0)") * price(prompt_usd * 1e6)).cast("bigint")
    request = F.ceil(price(request_usd) * million).cast("bigint")
    b = bodies.withColumn("_in", S.input_upper("body"))
    per = b.groupBy(key).agg(F.sum(cost(F.col("_in")) + request).alias("_held"), F.count("*").alias("_n"))
    left = F.lit(available) - F.col("_held") - cost(F.lit(future_tokens)) - future_items * request
    share = F.floor(left / (F.col("_n") + future_items))
    money = F.floor(share.cast("decimal(20,0)") / price(completion_usd * 1e6)).cast("bigint") if completion_usd > 0 else F.lit(longest).cast("bigint")
    cap = F.least(F.lit(longest).cast("bigint"), F.lit(context).cast("bigint") - F.col("_in"), money)
    out = b.join(per, key).withColumn("_cap", F.when(left > 0, cap))
    least = F.min(F.coalesce("_cap", F.lit(0))).over(Window.partitionBy(key))
    return out.withColumn("_least", least).select(*bodies.columns, F.when(F.col("_least") >= 1, F.col("_cap")).alias("max_tokens"))


@dataclass
class Bridge:
    """A way to fill a word: whose label it takes, how far that one may be, and what else has to hold (word, before, after)."""

    side: str
    gap: float
    holds: Callable[[dict, dict | None, dict | None], bool]


# in order; the label that is taken has to be a verified one
BRIDGES = (
    Bridge("before", 4.0, lambda w, p, n: n is not None and n["speaker"] == p["speaker"] and n["start"] - w["end"] <= 4.0),
    Bridge("before", 2.0, lambda w, p, n: (w["text"] or "").rstrip()[-1:] in tuple(".,:;?!")),
    Bridge("after", 0.5, lambda w, p, n: (n["text"] or "")[:1].islower()),
)


class BridgeWords(Fold):
    """Short unlabelled words take a verified neighbour's label; a word that was filled counts as the neighbour of the next."""

    def __init__(self, longest: float = 1.0, bridges: Sequence[Bridge] = BRIDGES) -> None:
        self.longest, self.bridges, self.window = longest, bridges, [None, None]  # the word before, done; the word now

    def _filled(self, w: dict, before: dict | None, after: dict | None) -> str | None:
        for b in self.bridges:
            other = before if b.side == "before" else after
            if other is None or not (other["speaker"] or "").startswith("profile:"):
                continue
            gap = w["start"] - other["end"] if b.side == "before" else other["start"] - w["end"]
            if gap <= b.gap and b.holds(w, before, after):
                return other["speaker"]
        return None

    def row(self, r: dict | None) -> Iterable[dict]:
        before, now = self.window
        if now is None:
            self.window = [before, r]
            return ()
        took = self._filled(now, before, r) if now["speaker"] is None and now["end"] - now["start"] <= self.longest else None
        self.window = [{**now, "speaker": took or now["speaker"]}, r]
        return ({"pos": now["pos"], "speaker": took or now["speaker"], "filled": took is not None},)

    def end(self) -> Iterable[dict]:
        return self.row(None)


def bridge_words(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, speaker, filled) of words (pos, start, end, text, speaker)."""
    return fold(words.select(*keys, "pos", "start", "end", "text", "speaker"), keys, ["pos"], BridgeWords, "pos bigint, speaker string, filled boolean")


def bridge_phrases(words: DataFrame, keys: Sequence[str], phrase: str = "phrase", longest: float = 2.5, gap: float = 1.0) -> DataFrame:
    """Whole unlabelled phrases of at most ``longest`` between words of one and the same verified speaker, at most ``gap`` from both, take that label."""
    p = words.groupBy(*keys, phrase).agg(
        F.min("pos").alias("_p"), F.min("start").alias("_s"), F.max("end").alias("_e"), F.bool_and(F.col("speaker").isNull()).alias("_open"), F.min_by("speaker", "pos").alias("_first"), F.max_by("speaker", "pos").alias("_last"),
    )
    w = Window.partitionBy(*keys).orderBy("_p")
    who, until, next_, from_ = F.lag("_last").over(w), F.lag("_e").over(w), F.lead("_first").over(w), F.lead("_s").over(w)
    ok = F.col("_open") & (F.col("_e") - F.col("_s") <= longest) & (who == next_) & who.startswith("profile:") & (F.col("_s") - until <= gap) & (from_ - F.col("_e") <= gap)
    p = p.withColumn("_who", F.when(ok, who)).select(*keys, phrase, "_who")
    return words.join(p, [*keys, phrase], "left").withColumn("filled", F.col("speaker").isNull() & F.col("_who").isNotNull()).withColumn("speaker", F.coalesce("speaker", "_who")).drop("_who")


def utterance_words(utterances: DataFrame, words: DataFrame, keys: Sequence[str], width: float = 10.0) -> DataFrame:
    """Utterances with text, numbered before empty ones go, and the ids of the words of the same speaker that overlap them.

    utterances: pos, start, end, speaker, text; words: pos, start, end, speaker, source_word_ids.
    """
    numbered = utterances.withColumn("utterance_id", F.format_string("U%05d", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    pairs = intervals.interval_join(numbered.select(*keys, "utterance_id", "start", "end", "speaker"), words.select(*keys, "pos", "start", "end", "speaker", "source_word_ids"), keys, width).where(F.col("speaker").eqNullSafe(F.col("r_speaker")))
    rows = F.array_sort(F.collect_list(F.struct("r_pos", "r_source_word_ids")))
    ids = pairs.groupBy(*keys, "utterance_id").agg(F.array_distinct(F.flatten(F.transform(rows, lambda x: x["r_source_word_ids"]))).alias("source_word_ids"))
    return numbered.join(ids, [*keys, "utterance_id"], "left").withColumn("source_word_ids", F.coalesce("source_word_ids", F.array().cast("array<string>")))
