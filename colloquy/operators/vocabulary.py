"""Domain vocabulary over words: phrases, single words, and words that need a context."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .sequence import Fold, clauses, fold, islands

EDGES = r"(?U)^([^\w@]*)(.*?)([^\w]*)$"


class Phrases(Fold):
    """Finds phrases of folded words from left to right, the longest first; the words of one found begin no other.

    Rows: pos, token, tail and others.  Out: the rows that begin a phrase or are in none, with last_pos and tail of the
    phrase's last word and its number in the list (null without one).
    """

    def __init__(self, phrases: Sequence[tuple[str, ...]]) -> None:
        self.known = {p: i for i, p in enumerate(phrases)}
        self.sizes = sorted({len(p) for p in phrases}, reverse=True) or [1]
        self.held: list[dict] = []

    def _take(self, final: bool) -> Iterable[dict]:
        while self.held and (final or len(self.held) >= self.sizes[0]):
            tokens = tuple(r["token"] for r in self.held)
            size = next((k for k in self.sizes if tokens[:k] in self.known and k <= len(tokens)), 0)
            last = self.held[max(size, 1) - 1]
            yield {**self.held[0], "last_pos": last["pos"], "tail": last["tail"], "phrase": self.known[tokens[:size]] if size else None}
            del self.held[: max(size, 1)]

    def row(self, r: dict) -> Iterable[dict]:
        self.held.append(r)
        return list(self._take(False))

    def end(self) -> Iterable[dict]:
        return list(self._take(True))


def apply_vocabulary(words: DataFrame, keys: Sequence[str], phrases: dict[str, str], replacements: dict[str, str], rules: Sequence[dict] = (), uncertain: Column | None = None) -> DataFrame:
    """(keys, pos, last_pos, text, policy): words with phrases as one word, known words replaced, and words by rules where a required word is within five; punctuation stays.

    A rule: source, target, required_context, require_asr_uncertainty.  policy: SAFE_EXACT, CONTEXT_REQUIRED or null.
    """
    part = lambda k: F.regexp_extract(F.coalesce("text", F.lit("")), EDGES, k)
    order = Window.partitionBy(*keys).orderBy("pos")
    near = F.concat_ws(" ", F.collect_list(S.fold("text")).over(order.rowsBetween(-5, 5)))
    doubt = uncertain if uncertain is not None else F.lit(False)
    placed = words.repartition(*[F.col(k) for k in keys])  # the window and the fold share this shuffle, and nothing is joined
    w = placed.select(*keys, "pos", "text", part(1).alias("head"), S.fold(part(2)).alias("token"), part(3).alias("tail"), near.alias("_near"), F.coalesce(doubt, F.lit(False)).alias("_doubt"))
    plain = F.try_element_at(F.create_map(*[F.lit(x) for k, v in replacements.items() for x in (k.casefold(), v)]), F.col("token")) if replacements else F.lit(None).cast("string")
    by_rule = F.lit(None).cast("string")
    for r in reversed(list(rules)):
        hit = F.lit(False)
        for word in r["required_context"]:
            hit = hit | F.col("_near").contains(word.casefold())
        if r.get("require_asr_uncertainty"):
            hit = hit & F.col("_doubt")
        by_rule = F.when((F.col("token") == r["source"].casefold()) & hit, r["target"]).otherwise(by_rule)
    texts = list(phrases)
    kinds = dict(words.dtypes)
    w = w.select(*keys, "pos", "text", "head", "token", "tail", plain.alias("plain"), by_rule.alias("by_rule"))
    out = f"pos {kinds['pos']}, last_pos {kinds['pos']}, text string, head string, tail string, plain string, by_rule string, phrase int"
    j = fold(w, keys, ["pos"], lambda: Phrases([tuple(t.casefold().split()) for t in texts]), out, placed=True)
    target = F.get(F.array(*[F.lit(phrases[t]) for t in texts]), F.col("phrase")) if texts else F.lit(None).cast("string")
    exact = F.coalesce(target, "plain")
    new = F.coalesce(exact, "by_rule")
    policy = F.when(exact.isNotNull(), "SAFE_EXACT").when(F.col("by_rule").isNotNull(), "CONTEXT_REQUIRED")
    return j.select(*keys, "pos", "last_pos", F.when(new.isNotNull(), F.concat("head", new, "tail")).otherwise(F.col("text")).alias("text"), policy.alias("policy"))


def identity_clauses(words: DataFrame, keys: Sequence[str], gap: float = 0.25, pause: float = 2.5) -> DataFrame:
    """Clauses that also end where, after a silence of at least ``gap``, the supported identity or the set of tracks is another: column clause.

    words: pos, start, end, text, profile (null: no support), tracks (array; null or empty: none).
    """
    c = clauses(words, keys, pause).withColumnRenamed("clause", "_clause")
    w = Window.partitionBy(*keys, "_clause").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    tracks = F.when(F.size(F.coalesce("tracks", F.array().cast("array<string>"))) > 0, F.array_sort(F.array_distinct("tracks")))
    other = (F.col("profile") != F.last("profile", ignorenulls=True).over(before)) | (tracks != F.last(tracks, ignorenulls=True).over(before))
    split = (F.row_number().over(w) == 1) | (F.coalesce(other, F.lit(False)) & (F.greatest(F.lit(0.0), F.col("start") - F.lag("end").over(w)) >= gap))
    return islands(c.withColumn("_split", split), keys, ["pos"], F.col("_split"), "clause").drop("_clause", "_split")
