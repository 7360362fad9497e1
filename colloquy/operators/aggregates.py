"""Aggregations: uncertainty, coverage, deduplication, log rollups, rolling spend, batch outcomes, top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals
from .matching import top_per


def uncertainty(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per utterance: least confidences, all reasons, shares of inferred and of reviewed words.

    words: confidence, speaker_confidence, flags.
    """
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    inferred = F.arrays_overlap(flags, F.array(*map(F.lit, ("ambiguous", "no_diarization", "speaker_context", "speaker_smoothed", "clause_coherence"))))
    out = words.groupBy(*keys).agg(
        F.min("confidence").alias("recognition"), F.min("speaker_confidence").alias("speaker"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(flags)))).alias("reasons"),
        F.bround(F.avg(inferred.cast("int")), 4).alias("inferred_word_ratio"), F.bround(F.avg((F.size(flags) > 0).cast("int")), 4).alias("review_word_ratio"),
    )
    return out.withColumn("needs_review", F.col("review_word_ratio") > 0)


def coverage(expected: DataFrame, covered: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """expected rows, covered ones, ratio (1 if nothing is expected)."""
    hit = covered.select(key).distinct().withColumn("_hit", F.lit(1))
    out = expected.join(hit, key, "left").groupBy(*by).agg(F.count("*").alias("expected"), F.count("_hit").alias("covered"))
    return out.withColumn("coverage", F.when(F.col("expected") > 0, F.col("covered") / F.col("expected")).otherwise(1.0))


def missing(expected: DataFrame, received: DataFrame, key: str) -> DataFrame:
    return expected.join(received.select(key), key, "left_anti")


def time_coverage(ranges: DataFrame, total: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of ``total`` (keys, duration) that the union of ranges covers, at most 1."""
    m = intervals.measure(ranges, keys)
    return total.join(m, list(keys), "left").select(*keys, F.least(F.lit(1.0), F.coalesce("measure", F.lit(0.0)) / F.greatest(F.lit(1e-9), F.col("duration"))).alias("coverage"))


def deduplicate(facts: DataFrame, text: str, keys: Sequence[str], order: Sequence[str], lineage: str) -> DataFrame:
    """One row per folded text and keys: the first by ``order``, with the union of all lineage ids and F%05d numbers."""
    folded = S.squeezed(text)
    groups = facts.withColumn("_t", folded).groupBy("_t", *keys).agg(F.min_by(F.struct(*facts.columns), F.struct(*order)).alias("_r"), F.array_sort(F.collect_set(lineage)).alias("lineage"), F.count("*").alias("n_merged"))
    return groups.select("_r.*", "lineage", "n_merged")


def floor_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, cells: int = 200) -> DataFrame:
    """The value at index floor((n - 1) * p) of the sorted values, without interpolation: (keys, n, percentile).

    Values are counted in cells between approximate quantiles; only those of the cell that has the index are
    sorted, so a key with most of the rows is no single task's work.
    """
    rows = df.where(F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(k / cells) for k in range(1, cells)]), F.lit(10 * cells)).alias("_ends"), F.count("*").alias("_n"))
    same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys]
    named = lambda d: d.select(*[F.col(k).alias(f"_k{k}") for k in keys], *[c for c in d.columns if c not in keys])
    cell = F.size(F.filter("_ends", lambda e: e < F.col(value)))
    placed = rows.join(named(ends), same("", "_k")).select(*keys, F.col(value).alias("_v"), cell.alias("_cell"), "_n") if keys else rows.join(ends).select(F.col(value).alias("_v"), cell.alias("_cell"), "_n")
    counts = placed.groupBy(*keys, "_cell", "_n").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_cell")) - F.col("_c")  # at most ``cells`` rows a key
    at = F.floor((F.col("_n") - 1) * p)
    hit = counts.withColumn("_skip", at - before).where((F.col("_skip") >= 0) & (F.col("_skip") < F.col("_c")))
    inside = placed.drop("_n").join(named(hit.drop("_c")).withColumnRenamed("_cell", "_hit"), [*same("", "_k"), F.col("_cell") == F.col("_hit")])
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1).where("_r = _skip")
    return ranked.select(*keys, F.col("_n").alias("n"), F.col("_v").alias("percentile"))


def log_rollup(log: DataFrame) -> DataFrame:
    """Events per category, name and outcome with their first and last time, errors and latency."""
    return log.groupBy("category", "name", "outcome").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count_if(F.col("severity").isin("error", "critical")).alias("errors"), F.max("duration_ms").alias("max_ms"))


def rolling_sum(df: DataFrame, keys: Sequence[str], time: Column, amount: Column, span: int) -> DataFrame:
    """Sum of ``amount`` over the last ``span`` units of ``time``, the row's own time included (column rolling)."""
    w = Window.partitionBy(*keys).orderBy("_time").rangeBetween(-span, 0)
    return df.withColumn("_time", time).withColumn("rolling", F.sum(amount).over(w)).drop("_time")


# fixed values: attempts that never cost anything
FREE = ("rejected_no_charge", "rejected_before_submit", "cancelled_before_submit")


def spent(attempts: DataFrame, holds: DataFrame, now: Column, span: float = 7 * 86400.0) -> DataFrame:
    """What counts against the budget (one row, spent_microusd).

    Attempts count as billed, or else as reserved.  Of an open workflow all of them count, its hold at least.  Others count from the
    ``span`` before ``now``, and longer if they were sent and no bill came: time is no sign that they were free.  A reservation that
    was never sent lapses with the span.

    attempts: workflow_id, status, posts, created_at, reserved_microusd, billed_microusd; holds: workflow_id, hold_microusd of open workflows.
    """
    cost = F.coalesce("billed_microusd", "reserved_microusd")
    real = attempts.where(~F.coalesce(F.col("status").isin(*FREE), F.lit(False)))
    lasting = (F.col("created_at") >= now - span) | (F.col("billed_microusd").isNull() & (F.coalesce("posts", F.lit(0)) > 0))
    done = real.where(lasting).join(holds.select("workflow_id"), "workflow_id", "left_anti").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("x"))
    per = real.groupBy("workflow_id").agg(F.sum(cost).alias("_a"))
    held = holds.join(per, "workflow_id", "left").agg(F.coalesce(F.sum(F.greatest("hold_microusd", F.coalesce("_a", F.lit(0)))), F.lit(0)).alias("y"))
    return done.join(held).select((F.col("x") + F.col("y")).alias("spent_microusd"))  # one row each


def batch_outcomes(expected: DataFrame, received: DataFrame, key: str, valid: Column) -> DataFrame:
    """(key, outcome): ok, invalid, missing, duplicate or extra."""
    got = received.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.bool_and(valid).alias("_ok"))
    both = expected.select(F.col(key).alias("_e")).distinct().join(got, F.col("_e").eqNullSafe(F.col("_k")), "full")
    outcome = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "duplicate").when(F.col("_ok"), "ok").otherwise("invalid")
    return both.select(F.coalesce("_e", "_k").alias(key), outcome.alias("outcome"))


def status_counts(df: DataFrame, status: str, domain: Sequence[str]) -> DataFrame:
    """Rows per status, zero for those of the domain that don't occur."""
    names = df.sparkSession.createDataFrame([(s,) for s in domain], f"`{status}` string")
    return names.join(df.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def modal(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key, the earliest on ties."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return per.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col("_first")).alias("_t"))).alias(value))


def lattice(alternatives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alternatives (text, score) by score, and whether they agree when folded."""
    best = F.sort_array(F.collect_list(F.struct("score", "text")), asc=False)
    return alternatives.groupBy(*keys).agg(F.transform(best, lambda x: x["text"]).alias("alternatives"), (F.count_distinct(S.fold("text")) == 1).alias("consensus"))


def snapshot_digest(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A digest per key over its rows in order of their fields."""
    return df.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))), 256).alias("digest"), F.count("*").alias("n"))


top_per_group = top_per


def mandatory_budget(df: DataFrame, mandatory: Column, score: str, tie: str, budget: int, least: float) -> DataFrame:
    """Mandatory rows, and of the others that reach ``least`` the best until ``budget`` rows are taken."""
    must = df.where(mandatory)
    room = max(0, budget - must.limit(budget + 1).count())
    return must.unionByName(df.where(~mandatory & (F.col(score) >= least)).orderBy(F.col(score).desc(), tie).limit(room))


# fixed values: bounds and factors of views
VIEW_BOUNDS = {"executive": (4, 8), "rules": (1, 6), "technical": (4, 12), "experiments": (2, 10), "questions": (3, 10)}
VIEW_FACTOR = {"executive": 0.55, "rules": 0.35, "technical": 0.85, "tasks": 0.7, "experiments": 0.8, "questions": 0.7, "minutes": 2.0}


# fixed values: shares of the overall bounds that a policy gives each view
VIEW_SHARES = {"executive": (0.2, 0.4), "rules": (0.05, 0.25), "technical": (0.2, 0.55), "tasks": (0.15, 1.0), "experiments": (0.1, 0.4), "questions": (0.1, 0.4)}


def view_bounds(view: str, minimum: int, maximum: int, policy: tuple[int, int] | None = None) -> tuple[int, int]:
    """Least and most claims of a view; ``policy``: overall bounds, of which each view has its shares."""
    if policy is None:
        return {"tasks": (3, maximum), "minutes": (minimum, maximum)}.get(view) or VIEW_BOUNDS.get(view, (minimum, maximum))
    low, high = VIEW_SHARES.get(view, (1.0, 1.0))
    if view in VIEW_SHARES:
        return max(1, math.ceil(policy[0] * low)), max(1, math.ceil(policy[1] * high))
    return policy if view == "minutes" else (minimum, maximum)


def adaptive_budget(claims: DataFrame, n_episodes: int, minimum: int = 7, maximum: int = 120, view: str = "minutes", policy: tuple[int, int] | None = None) -> DataFrame:
    """How many claims a view may take: ceil(sqrt(minutes) + 1.5 threads + mandatory + kinds), times the view's factor, in its bounds.

    claims: start, end, thread_id, kind, mandatory, lifecycle.
    """
    low, high = view_bounds(view, minimum, maximum, policy)
    active = claims.where(F.coalesce("lifecycle", F.lit("active")) == "active")
    minutes = F.greatest(F.lit(1.0), F.coalesce(F.max(F.coalesce("end", "start")), F.lit(0.0)) / 60)
    threads = F.count_distinct("thread_id")
    base = F.ceil(F.sqrt(minutes) + 1.5 * F.when(threads > 0, threads).otherwise(n_episodes) + F.count_if("mandatory") + F.count_distinct("kind"))
    return active.agg(F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(base * VIEW_FACTOR.get(view, 1.0)))).cast("int").alias("budget"))


def windowed_candidates(facts: DataFrame, total: float, limit: int = 18, windows: int = 6) -> DataFrame:
    """Facts (fact_id, start, priority, text) spread over equal time windows, then filled up by priority to ``limit``."""
    width = total / windows
    bucket = F.floor(F.col("start") / width)
    middle = (bucket + 0.5) * width
    inside = facts.where((F.col("start") >= 0) & (F.col("start") < total)).withColumn("_w", bucket)
    order = [F.col("priority"), F.length("text").desc(), F.abs(F.col("start") - middle), F.col("fact_id")]
    first = top_per_group(inside, ["_w"], order, limit // windows).drop("rank", "_w").withColumn("_round", F.lit(0))
    rest = facts.join(first.select("fact_id"), "fact_id", "left_anti").withColumn("_round", F.lit(1))
    return first.unionByName(rest).orderBy("_round", "priority", F.length("text").desc(), "start", "fact_id").limit(limit).drop("_round")


def ranked_repairs(spans: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` spans with the largest risk * importance * probability, earlier first on ties."""
    return spans.withColumn("worth", F.col("risk") * F.col("importance") * F.col("probability")).orderBy(F.col("worth").desc(), "start", "span_id").limit(budget)


def reordered_section(items: DataFrame, keys: Sequence[str], pos: str, section: Column, order: Sequence[Column]) -> DataFrame:
    """Sorts the rows of one section among the places they have; all others keep theirs (column place)."""
    chosen = items.where(section)
    slots = chosen.select(*keys, F.col(pos).alias("place")).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("place")))
    ranked = chosen.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(slots, [*keys, "_k"]).drop("_k").unionByName(items.where(~section).withColumn("place", F.col(pos)))
