"""Sequence operators: islands by window functions, and folds where state restarts.

``fold`` streams the rows of each key, in order, through a small state machine
in Arrow batches; it never holds a group, so a recording of any length passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERMINAL = (".", "?", "!", "…")


def _ends_sentence(text: Column) -> Column:
    return F.coalesce(F.rtrim(text), F.lit("")).rlike("[.?!…]$")


# ---------------------------------------------------------------- islands


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0: a row begins a new one where ``starts`` holds (null counts as true)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_first", first).withColumn(name, F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """Runs of equal ``value``; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return islands(df, keys, order, first | ~F.col(value).eqNullSafe(F.lag(value).over(w)), name)


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, gap, start: str = "start", end: str = "end", text: str | None = None, continuation_gap=None) -> DataFrame:
    """Sessions of equal label: a new one on change of label or on a gap over ``gap`` after the previous row.

    With ``text`` the longer ``continuation_gap`` holds after a row that doesn't end a sentence.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    limit = F.lit(gap)
    if text is not None:
        limit = F.when(_ends_sentence(F.lag(text).over(w)), F.lit(gap)).otherwise(F.greatest(F.lit(gap), F.lit(continuation_gap)))
    change = (F.row_number().over(w) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.col(start) - F.lag(end).over(w) > limit)
    return islands(df, keys, order, change, "session")


def utterances(words: DataFrame, keys: Sequence[str], gap: float = 1.2, continuation_gap: float = 3.0) -> DataFrame:
    """Words (pos, start, end, speaker, text, flags) to utterances."""
    s = sessions(words, keys, ["pos"], "speaker", gap, text="text", continuation_gap=continuation_gap)
    one = s.groupBy(*keys, "session").agg(
        F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.min_by("speaker", "pos").alias("speaker"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")).alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
    )
    return one.withColumn("utterance_id", F.format_string("U%05d", F.col("session") + 1))


def merge_near(df: DataFrame, keys: Sequence[str], gap, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of equal keys merged across gaps of at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = islands(df, keys, [start, end], before.isNull() | (F.col(start) - before > gap))
    return s.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("island")


def clauses(units: DataFrame, keys: Sequence[str], gap: float = 2.5) -> DataFrame:
    """Joins units (pos, start, end, text of the last word) while no sentence ends and the gap is at most ``gap``: column clause."""
    w = Window.partitionBy(*keys).orderBy("pos")
    new = (F.row_number().over(w) == 1) | (F.col("start") - F.lag("end").over(w) > gap) | _ends_sentence(F.lag("text").over(w))
    return islands(units, keys, ["pos"], new, "clause")


def smooth(words: DataFrame, keys: Sequence[str], unit: str, label: str = "speaker", dominance: float = 0.55, longest: float = 1.2, protected: str | None = None) -> DataFrame:
    """Short runs of other labels in a unit take its dominant label, if that has ``dominance`` of the time; runs with ``protected`` rows stay."""
    d = F.greatest(F.lit(0.04), F.col("end") - F.col("start"))
    r = runs(words.withColumn("_d", d), [*keys, unit], ["pos"], label, "_run")
    per = Window.partitionBy(*keys, unit)
    by_label = r.where(F.col(label).isNotNull()).groupBy(*keys, unit, F.col(label).alias("_label")).agg(F.sum("_d").alias("_w"), F.min("pos").alias("_p"))
    best = by_label.groupBy(*keys, unit).agg(F.max(F.struct("_w", (-F.col("_p")).alias("_q"), "_label")).alias("_b"), F.sum("_w").alias("_all"))
    run = Window.partitionBy(*keys, unit, "_run")
    guarded = F.bool_or(F.coalesce(F.col(protected), F.lit(False))).over(run) if protected else F.lit(False)
    out = r.withColumn("_len", F.sum("_d").over(run)).withColumn("_guard", guarded).withColumn("_n", F.max("_run").over(per)).join(best, [*keys, unit], "left")
    change = (F.col("_n") > 0) & (F.col("_b._w") / F.col("_all") >= dominance) & (F.col("_len") <= longest) & ~F.col("_guard") & ~F.col(label).eqNullSafe(F.col("_b._label"))
    return out.withColumn("smoothed", F.coalesce(change, F.lit(False))).withColumn(label, F.when(F.coalesce(change, F.lit(False)), F.col("_b._label")).otherwise(F.col(label))).drop("_d", "_run", "_len", "_guard", "_n", "_b", "_all")


def bridge_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, longest, start: str = "start", end: str = "end") -> DataFrame:
    """Runs of null labels between rows of one and the same label take it, if they last at most ``longest``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # what follows a row is what comes before it the other way round: a running frame, not one that is gone through anew from every row
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(label, ignorenulls=True).over(back)
    t0 = F.last(F.when(F.col(label).isNotNull(), F.col(end)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t1 = F.last(F.when(F.col(label).isNotNull(), F.col(start)), ignorenulls=True).over(back)
    fill = F.col(label).isNull() & (before == after) & (t1 - t0 <= longest)
    return df.withColumn("bridged", F.coalesce(fill, F.lit(False))).withColumn("_before", before).withColumn(label, F.when(F.col("bridged"), F.col("_before")).otherwise(F.col(label))).drop("_before")


def without_repeats(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], chunk_start: str = "chunk_start", previous_end: str = "previous_end") -> DataFrame:
    """Rows of ``incoming`` less words that repeat one of ``existing`` in the overlap of two chunks; words left in the overlap get the flag asr_boundary.

    Equal words: the same letters, starts less than .25 and ends less than .35 apart.
    """
    from ..functions.scalars import word_equality_key

    inside = F.coalesce((F.col("start") >= F.col(chunk_start) - 0.1) & (F.col("end") <= F.col(previous_end) + 0.1) & (F.col(previous_end) > F.col(chunk_start)), F.lit(False))
    new = incoming.withColumn("_in", inside).withColumn("_w", word_equality_key("text"))
    old = existing.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("start").alias("_s"), F.col("end").alias("_e"), word_equality_key("text").alias("_w2"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys] + [F.col("_w") == F.col("_w2"), F.col("_in"), F.abs(F.col("start") - F.col("_s")) < 0.25, F.abs(F.col("end") - F.col("_e")) < 0.35, F.col("_s") >= F.col(chunk_start) - 0.1, F.col("_e") <= F.col(previous_end) + 0.1]
    kept = new.join(old, same, "left_anti")
    flags = F.coalesce("flags", F.array().cast("array<string>")) if "flags" in incoming.columns else F.array().cast("array<string>")
    return kept.withColumn("flags", F.when(F.col("_in"), F.array_distinct(F.array_append(flags, F.lit("asr_boundary")))).otherwise(flags)).drop("_in", "_w")


def word_ids(words: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """word_id W%08d by place, where there is none."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    own = F.nullif(F.col("word_id"), F.lit("")) if "word_id" in words.columns else F.lit(None).cast("string")
    return words.withColumn("word_id", F.coalesce(own, F.format_string("W%08d", n)))


def tumbling_ranges(df: DataFrame, total: str, size: int) -> DataFrame:
    """One row per range of ``size``: range_start, range_end."""
    return df.where(F.col(total) > 0).withColumn("range_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(total).cast("bigint") - 1, F.lit(size).cast("bigint")))).withColumn("range_end", F.least(F.col("range_start") + size, F.col(total).cast("bigint")))


def sliding_ranges(df: DataFrame, total: str, size: float, step: float, least: float) -> DataFrame:
    """Windows of ``size`` every ``step`` with at least ``least`` in them."""
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col(total) / step).cast("int"))), lambda k: k * F.lit(step))
    out = df.withColumn("range_start", F.explode(starts)).withColumn("range_end", F.least(F.col("range_start") + size, F.col(total).cast("double")))
    return out.where(F.col("range_end") - F.col("range_start") >= least)


# ---------------------------------------------------------------- folds


class Fold:
    """State of one group: ``row`` takes a dict and returns finished rows (dicts), ``end`` the last ones."""

    def row(self, r: dict) -> Iterable[dict]:
        raise NotImplementedError

    def end(self) -> Iterable[dict]:
        return ()


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Fold], schema: str, placed: bool = False) -> DataFrame:
    """Streams the rows of each key in order through a Fold; ``schema``: its output columns, which follow the keys.

    ``placed``: ``df`` is dealt by ``keys`` already.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    out_schema = T._parse_datatype_string(f"{fields}, {schema}" if keys else schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()

        for b in batches:
            for r in b.to_pylist():
                key = tuple(r[k] for k in keys)
                if state is None or key != now:
                    if state is not None:
                        out.extend({**dict(zip(keys, now, strict=True)), **x} for x in state.end())
                    now, state = key, make()
                out.extend({**dict(zip(keys, key, strict=True)), **x} for x in state.row(r))
                if len(out) >= 1000:
                    yield from flush()
        if state is not None:
            out.extend({**dict(zip(keys, now, strict=True)), **x} for x in state.end())
        yield from flush()

    dealt = df if placed else df.repartition(*[F.col(k) for k in keys]) if n else df.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)


def fold_along(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Fold], uses: Sequence[str], name: str, kind: str) -> DataFrame:
    """``df`` with a column more, ``name`` of type ``kind``: of each row, the field of that name in the one row that a Fold returns for it.

    Folds see the columns ``uses`` alone; the others stay in Arrow, and nothing has to be joined again.  ``df`` is
    to be dealt by ``keys`` already, so that windows by them share its shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    out_schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    arrow = to_arrow_type(out_schema[name].dataType)
    seen = [*dict.fromkeys((*keys, *uses))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            found = []
            for r in b.select(seen).to_pylist():
                key = tuple(r[k] for k in keys)
                if state is None or key != now:
                    now, state = key, make()
                (x,) = state.row(r)
                found.append(x[name])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, arrow)], names=[*b.schema.names, name])

    return df.sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)


class PhraseUnits(Fold):
    """Words to units: a pause, the end of a sentence or a unit over ``longest`` begins a new one."""

    def __init__(self, pause: float = 0.65, longest: float = 10.0) -> None:
        self.pause, self.longest, self.n, self.start, self.last = pause, longest, -1, 0.0, None

    def row(self, r: dict) -> Iterable[dict]:
        p = self.last
        if p is None or max(0.0, r["start"] - p["end"]) >= self.pause or (p["text"] or "").rstrip("\"'»”)]}").endswith(TERMINAL) or r["end"] - self.start > self.longest:
            self.n, self.start = self.n + 1, r["start"]
        self.last = r
        return ({"pos": r["pos"], "unit": self.n},)


class Neighbours(Fold):
    """Short rows without a label take that of their nearest neighbour with one; what a row took counts for the rows after it.

    Rows have the first labelled row behind them as ``_next`` (its start and label).  Two neighbours of different
    labels have to differ by more than ``lead`` in their distance.
    """

    def __init__(self, label: str, shortest: float = 0.35, reach: float = 0.4, lead: float = 0.12) -> None:
        self.label, self.shortest, self.reach, self.lead = label, shortest, reach, lead
        self.before: tuple[float, str] | None = None

    def near(self, r: dict) -> str | None:
        if r["end"] - r["start"] > self.shortest:
            return None
        at = [(max(0.0, r["start"] - self.before[0]), self.before[1])] if self.before else []
        if r["_next"] is not None:
            at.append((max(0.0, r["_next"]["start"] - r["end"]), r["_next"]["label"]))
        at.sort()
        if not at or at[0][0] > self.reach:
            return None
        return at[0][1] if len(at) == 1 or at[1][1] == at[0][1] or at[0][0] + self.lead < at[1][0] else None

    def row(self, r: dict) -> Iterable[dict]:
        found = r[self.label] if r[self.label] is not None else self.near(r)
        if found is not None:
            self.before = (r["end"], found)
        return ({"_found": found},)


def fill_from_neighbours(rows: DataFrame, keys: Sequence[str], row_id: str, order: Sequence[str], label: str, shortest: float = 0.35, reach: float = 0.4, lead: float = 0.12) -> DataFrame:
    """``rows`` (start, end, label) with labels filled in from neighbours, and whether a row's label was (inferred)."""
    # what follows a row is what comes before it the other way round, which a running frame gives without looking ahead anew from every row
    behind = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in (*order, row_id)]).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(label).isNotNull(), F.struct(F.col("start").cast("double").alias("start"), F.col(label).alias("label")))
    placed = rows.repartition(*[F.col(k) for k in keys]).withColumn("_next", F.last(known, ignorenulls=True).over(behind))
    out = fold_along(placed, keys, [*order, row_id], lambda: Neighbours(label, shortest, reach, lead), ["start", "end", label, "_next"], "_found", dict(rows.dtypes)[label])
    return out.select(*[F.col("_found").alias(c) if c == label else F.col(c) for c in rows.columns], (F.col(label).isNull() & F.col("_found").isNotNull()).alias("inferred"))


class Captions(Fold):
    """Words of one item to captions of at most ``longest`` seconds and ``chars`` characters."""

    def __init__(self, longest: float = 8.0, chars: int = 92) -> None:
        self.longest, self.chars, self.n, self.now = longest, chars, 0, None

    def row(self, r: dict) -> Iterable[dict]:
        c, text = self.now, r["text"] or ""
        if c is None or r["end"] - c["start"] > self.longest or len(c["text"]) + len(text) + 1 > self.chars:
            done = self.end()
            self.now = {"caption": self.n, "start": r["start"], "end": r["end"], "text": text}
            self.n += 1
            return done
        c["end"] = r["end"]
        c["text"] += " " + text
        return ()

    def end(self) -> Iterable[dict]:
        return (self.now,) if self.now else ()


class Packets(Fold):
    """Rows to packets of at most ``target`` in cost (length plus ``extra``); a single larger row stays whole."""

    def __init__(self, target: int, extra: int = 160) -> None:
        self.target, self.extra, self.n, self.size, self.k = target, extra, 0, 0, -1

    def row(self, r: dict) -> Iterable[dict]:
        cost = len(r["text"] or "") + self.extra
        self.k += 1
        if self.k and self.size and self.size + cost > self.target:
            self.n, self.size = self.n + 1, 0
        self.size += cost
        return ({"pos": r["pos"], "packet": self.n},)


def packets(df: DataFrame, keys: Sequence[str], target: int, context: int = 0, extra: int = 160) -> DataFrame:
    """(keys, packet, pos, role): each row as core of one packet, and as context of packets whose core it is near."""
    core = fold(df.select(*keys, "pos", "text"), keys, ["pos"], lambda: Packets(target, extra), "pos bigint, packet int")
    numbered = core.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    if not context:
        return numbered.select(*keys, "packet", "pos", F.lit("core").alias("role"))
    w = Window.partitionBy(*keys).orderBy("_n")
    near = F.array_distinct(F.flatten(F.array(F.collect_list("packet").over(w.rowsBetween(-context, context)))))
    out = numbered.withColumn("_near", near).select(*keys, "pos", F.col("packet").alias("_own"), F.explode("_near").alias("packet"))
    return out.select(*keys, "packet", "pos", F.when(F.col("packet") == F.col("_own"), "core").otherwise("context").alias("role"))


class SpeechChunks(Fold):
    """Speech regions to chunks of at most ``longest``: near regions merge, long ones are cut with an overlap."""

    def __init__(self, longest: float = 22.0, overlap: float = 0.45, gap: float = 0.45, least: float = 0.20) -> None:
        self.longest, self.overlap, self.gap, self.least, self.now = longest, overlap, gap, least, None

    def row(self, r: dict) -> Iterable[dict]:
        s, e = r["start"], r["end"]
        if self.now is None or s - self.now[1] > self.gap or e - self.now[0] > self.longest:
            done = list(self.end())
            self.now = [s, e]
            return done
        self.now[1] = max(self.now[1], e)
        return ()

    def end(self) -> Iterable[dict]:
        if self.now is None:
            return
        at, e = self.now
        while e - at > self.longest:
            yield {"start": at, "end": at + self.longest}
            at += self.longest - self.overlap
        if e - at >= self.least:
            yield {"start": at, "end": e}


class MergeUnits(Fold):
    """Adjacent units of one speaker merge while the gap and the whole stay in their limits."""

    def __init__(self, gap: float = 1.5, longest: float = 12.0) -> None:
        self.gap, self.longest, self.n, self.now = gap, longest, -1, None

    def row(self, r: dict) -> Iterable[dict]:
        p = self.now
        if p and r["speaker"] is not None and r["speaker"] == p["speaker"] and max(0.0, r["start"] - p["end"]) <= self.gap and r["end"] - p["start"] <= self.longest:
            p["end"] = r["end"]
        else:
            self.n += 1
            self.now = {"speaker": r["speaker"], "start": r["start"], "end": r["end"]}
        return ({"pos": r["pos"], "unit": self.n},)


class Episodes(Fold):
    """Claims (start, end, statement, entities, kind, cue, shift) to episodes by gap or topic boundary."""

    def __init__(self, max_gap: float = 150.0, threshold: float = 0.72) -> None:
        self.max_gap, self.threshold, self.n, self.recent = max_gap, threshold, -1, []

    @staticmethod
    def words(text: str | None) -> set[str]:
        import re

        return {x for x in re.findall("[a-zа-яё0-9]+", (text or "").casefold()) if len(x) > 2}

    def boundary(self, r: dict) -> float:
        before = self.recent[-1]
        gap = max(0.0, r["start"] - before["end"])
        a, b = self.words(r["statement"]), self.words(" ".join(x["statement"] or "" for x in self.recent))
        shift = 1 - len(a & b) / max(1, len(a | b))
        shared = set(r["entities"] or ()) & {e for x in self.recent for e in x["entities"] or ()}
        return min(1.0, gap / 300 + shift * 0.25 + (0 if shared else 0.35) + (0.2 if r["kind"] == "question" else 0) + (0.45 if r["cue"] else 0) + 0.5 * (r["shift"] or 0.0))

    def row(self, r: dict) -> Iterable[dict]:
        if not self.recent or r["start"] - self.recent[-1]["end"] > self.max_gap or self.boundary(r) >= self.threshold:
            self.n, self.recent = self.n + 1, []
        self.recent = [*self.recent[-3:], r]
        return ({"claim_id": r["claim_id"], "episode": self.n},)


class Zones(Fold):
    """Utterances (id, start, end, speaker) to zones near a target length, cut at pauses and changes of speaker."""

    def __init__(self, target: float = 300.0, least: float = 120.0, most: float = 480.0, pause: float = 0.8) -> None:
        self.target = max(least, target)
        self.most, self.pause, self.n, self.start, self.last = max(self.target, most), pause, 0, None, None

    def row(self, r: dict) -> Iterable[dict]:
        if self.last is not None:
            full = self.last["end"] - self.start >= self.most
            turn = r["end"] - self.start >= self.target and (r["start"] - self.last["end"] >= self.pause or r["speaker"] != self.last["speaker"])
            if full or turn:
                self.n, self.start = self.n + 1, r["start"]
        else:
            self.start = r["start"]
        self.last = r
        return ({"pos": r["pos"], "zone": self.n},)


class Budget(Fold):
    """Longest first up to ``total`` seconds, each cut to ``longest``, those under ``least`` left out."""

    def __init__(self, total: float = 30.0, longest: float = 12.0, least: float = 3.0) -> None:
        self.left, self.longest, self.least = total, longest, least

    def row(self, r: dict) -> Iterable[dict]:
        take = min(r["end"] - r["start"], self.longest, self.left)
        if take < self.least:
            return ()
        self.left -= take
        return ({"start": r["start"], "end": r["start"] + take},)


class Diverse(Fold):
    """Rows in order of worth: mandatory ones always, others until ``budget`` and unless one taken overlaps by ``limit``."""

    def __init__(self, budget: int, limit: float = 0.72) -> None:
        self.budget, self.limit, self.taken = budget, limit, []

    def row(self, r: dict) -> Iterable[dict]:
        words = Episodes.words(r["statement"])
        near = any(len(words & t) / max(1, min(len(words), len(t))) >= self.limit for t in self.taken)
        if not r["mandatory"] and (near or len(self.taken) >= self.budget):
            return ()
        self.taken.append(words)
        return ({"item_id": r["item_id"], "place": len(self.taken)},)


class Threads(Fold):
    """Episodes (topic, entities) join the first thread that is similar or shares an entity, or begin one.

    Rows may have the topic's distinct words as ``words``; without that column they are those of the folded topic.
    """

    def __init__(self, least: float = 0.18) -> None:
        self.least, self.threads = least, []

    def row(self, r: dict) -> Iterable[dict]:
        words, entities = set(r["words"] or ()) if "words" in r else Episodes.words(r["topic"]), set(r["entities"] or ())
        for k, (w, e) in enumerate(self.threads):
            if len(words & w) / max(1, len(words | w)) >= self.least or entities & e:
                w |= words
                e |= entities
                break
        else:
            k = len(self.threads)
            self.threads.append((set(words), set(entities)))
        return ({"episode_id": r["episode_id"], "thread": k},)


class Chapters(Fold):
    """Rows in order of worth: at most ``most``, two a topic, none that reads like one taken."""

    def __init__(self, most: int = 12, per_topic: int = 2, alike: float = 0.72) -> None:
        self.most, self.per_topic, self.alike, self.taken, self.topics = most, per_topic, alike, [], {}

    def row(self, r: dict) -> Iterable[dict]:
        from difflib import SequenceMatcher

        text, topic = " ".join((r["statement"] or "").split()).casefold(), " ".join((r["topic"] or "").split()).casefold()
        full = len(self.taken) >= self.most or topic and self.topics.get(topic, 0) >= self.per_topic
        if full or any(SequenceMatcher(None, text, t).ratio() >= self.alike for t in self.taken):
            return ()
        self.taken.append(text)
        self.topics[topic] = self.topics.get(topic, 0) + 1
        return ({"item_id": r["item_id"], "start": r["start"]},)


# fixed values: priorities of chapters
CHAPTER_PRIORITY = {"decision": 7, "action": 7, "problem": 6, "metric": 6, "proposal": 5, "hypothesis": 4, "current_state": 3, "observation": 2, "question": 1}


def chapters(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts (item_id, type, statement, topic, start) that make the chapters of each key."""
    table = F.create_map(*[F.lit(x) for kv in CHAPTER_PRIORITY.items() for x in kv])
    ranked = facts.withColumn("_p", -F.coalesce(F.try_element_at(table, F.col("type")), F.lit(2))).withColumn("_l", -F.length(F.trim(F.regexp_replace("statement", "(?U)\\s+", " "))))
    return fold(ranked.select(*keys, "item_id", "statement", "topic", "start", "_p", "_l"), keys, ["_p", "_l", "start", "item_id"], Chapters, f"item_id {facts.schema['item_id'].dataType.simpleString()}, start double")
