"""Interval algebra and interval joins.

Intervals have ``start`` and ``end`` (any numeric type); keys say which track
or recording they belong to.  Joins put each interval into fixed time buckets
and equi-join on (keys, bucket), so no plan has a nested loop; a pair is kept in
the one bucket that has the later of both starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def union(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Maximal intervals of the union per key; touching ones merge, empty ones go."""
    marked = df.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def measure(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Total length of the union per key, and its number of intervals."""
    return union(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("measure"), F.count("*").alias("n_intervals"))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width, how: str = "inner", left_names: tuple[str, str] = ("start", "end"), right_names: tuple[str, str] = ("start", "end"), closed: bool = False) -> DataFrame:
    """Pairs of overlapping intervals of equal keys.

    ``width``: bucket width, best a high percentile of the lengths.  Columns of
    ``right`` other than keys come with the prefix ``r_``.  ``how``: inner or left.
    ``closed``: intervals that only touch count too.
    """
    (ls, le), (rs, re_) = left_names, right_names
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    buckets = lambda s, e: F.sequence(F.floor(s / width).cast("bigint"), F.greatest(F.floor(s / width), F.floor(e / width)).cast("bigint"))
    lx = left.withColumn("_bucket", F.explode(buckets(F.col(ls), F.col(le))))
    rx = r.withColumn("_rbucket", F.explode(buckets(F.col(f"r_{rs}"), F.col(f"r_{re_}"))))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_rbucket")]
    hit = (F.col(ls) <= F.col(f"r_{re_}")) & (F.col(f"r_{rs}") <= F.col(le)) if closed else (F.col(ls) < F.col(f"r_{re_}")) & (F.col(f"r_{rs}") < F.col(le))
    pairs = lx.join(rx, cond + [hit, F.col("_bucket") == F.floor(F.greatest(F.col(ls), F.col(f"r_{rs}")) / width).cast("bigint")]).drop("_bucket", "_rbucket", *[f"_k_{k}" for k in keys])
    if how == "inner":
        return pairs
    # rows are told apart by what they hold: equal rows have equal partners
    alone = _without(left, pairs.select(*left.columns))
    return pairs.unionByName(alone, allowMissingColumns=True)


def _same(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [df[c].eqNullSafe(other[f"_same_{c}"]) for c in columns]


def _named(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"_same_{c}") for c in columns], *[c for c in rows.columns if c not in columns])


def _without(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` less the rows equal to one of ``rows``; null equals null."""
    other = _named(rows.distinct(), rows.columns)
    return df.join(other, _same(df, other, rows.columns), "left_anti")


def intersection_measure(left: DataFrame, right: DataFrame, keys: Sequence[str], width) -> DataFrame:
    """Length of the intersection of both unions per key."""
    pairs = interval_join(union(left, keys), union(right, keys), keys, width)
    return pairs.groupBy(*keys).agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("measure"))


def support(windows: DataFrame, tracks: DataFrame, keys: Sequence[str], window_id: str, label: str, width) -> DataFrame:
    """Overlap length of each label in each window: (keys, window_id, label, amount)."""
    pairs = interval_join(windows, tracks, keys, width)
    return pairs.groupBy(*keys, window_id, F.col(f"r_{label}").alias(label)).agg(F.sum(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("amount"))


def best_overlap(items: DataFrame, segments: DataFrame, keys: Sequence[str], item_id: str, segment_pos: str, width, least_share: float = 0.55, shortest: float = 0.04) -> DataFrame:
    """The segment that overlaps each item most (ties: first), if that is ``least_share`` of the item's length."""
    pairs = interval_join(items, segments, keys, width).withColumn("amount", overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    order = Window.partitionBy(*keys, item_id).orderBy(F.col("amount").desc(), f"r_{segment_pos}")
    best = pairs.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return best.where(F.col("amount") / F.greatest(F.lit(shortest), F.col("end") - F.col("start")) >= least_share)


def assign_labels(items: DataFrame, tracks: DataFrame, keys: Sequence[str], item_id: str, label: str, width, least_share: float = 0.35, least_margin: float = 0.15, shortest: float = 0.04) -> DataFrame:
    """The label with most overlap per item, null unless its share and its lead over the second are large enough."""
    total = support(items, tracks, keys, item_id, label, width)
    order = Window.partitionBy(*keys, item_id).orderBy(F.col("amount").desc(), label)
    ranked = total.withColumn("_k", F.row_number().over(order)).groupBy(*keys, item_id).agg(F.max(F.when(F.col("_k") == 1, F.col(label))).alias("_best"), F.max(F.when(F.col("_k") == 1, F.col("amount"))).alias("_one"), F.max(F.when(F.col("_k") == 2, F.col("amount"))).alias("_two"))
    length = F.greatest(F.lit(shortest), F.col("end") - F.col("start"))
    share, second = F.coalesce("_one", F.lit(0)) / length, F.coalesce("_two", F.lit(0)) / length
    ok = (share >= least_share) & (share - second >= least_margin)
    return items.join(ranked, [*keys, item_id], "left").withColumn(label, F.when(ok, F.col("_best"))).withColumn("share", share).drop("_best", "_one", "_two")


def atomic_segments(df: DataFrame, keys: Sequence[str], label: str, width) -> DataFrame:
    """Segments between neighbouring endpoints with the sorted labels that cover them (uncovered ones are left out)."""
    points = df.where("end > start").select(*keys, F.explode(F.array("start", "end")).alias("start")).distinct()
    segments = points.withColumn("end", F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))).where("end is not null")
    pairs = interval_join(segments, df.where("end > start").select(*keys, "start", "end", label), keys, width)
    return pairs.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_set(f"r_{label}")).alias("labels"))


def disagreement_windows(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], label: str, width) -> DataFrame:
    """Segments of the first track where no overlapping label of the second is the same, or flagged overlap."""
    pairs = interval_join(primary, secondary.select(*keys, "start", "end", label), keys, width)
    seen = _named(pairs.groupBy(*primary.columns).agg(F.bool_and(F.col(label) != F.col(f"r_{label}")).alias("_differs")), primary.columns)
    flagged = F.coalesce(F.col("overlap"), F.lit(False)) if "overlap" in primary.columns else F.lit(False)
    return primary.join(seen, _same(primary, seen, primary.columns), "left").where(flagged | F.coalesce("_differs", F.lit(False))).select(*[primary[c] for c in primary.columns])


def clean_samples(df: DataFrame, keys: Sequence[str], label: str, width, n: int = 3, tolerance: float = 0.08, longest: float = 8.0) -> DataFrame:
    """Per label the ``n`` longest segments (capped at ``longest``; later first on ties) that no other label overlaps."""
    pairs = interval_join(df, df.select(*keys, "start", "end", label), keys, width).where(F.col(label) != F.col(f"r_{label}"))
    dirty = pairs.where(overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) > tolerance).select(*df.columns)
    order = Window.partitionBy(*keys, label).orderBy(F.least(F.col("end") - F.col("start"), F.lit(longest)).desc(), F.col("start").desc())
    return _without(df, dirty).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def error_rate(reference: DataFrame, hypothesis: DataFrame, keys: Sequence[str], label: str, width) -> DataFrame:
    """Miss, false alarm, confusion and their rate over reference time, on atomic segments, labels already mapped."""
    both = reference.select(*keys, "start", "end", F.concat(F.lit("r:"), label).alias("_l")).unionByName(hypothesis.select(*keys, "start", "end", F.concat(F.lit("h:"), label).alias("_l")))
    seg = atomic_segments(both, keys, "_l", width)
    pick = lambda side: F.transform(F.filter("labels", lambda x: x.startswith(side)), lambda x: F.substr(x, F.lit(3)))
    seg = seg.withColumn("_r", pick("r:")).withColumn("_h", pick("h:")).withColumn("_d", F.col("end") - F.col("start"))
    right = F.size(F.array_intersect("_r", "_h"))
    n_r, n_h = F.size("_r"), F.size("_h")
    total = seg.groupBy(*keys).agg(
        F.sum(n_r * F.col("_d")).alias("reference_time"),
        F.sum(F.greatest(F.lit(0), n_r - n_h) * F.col("_d")).alias("miss"),
        F.sum(F.greatest(F.lit(0), n_h - n_r) * F.col("_d")).alias("false_alarm"),
        F.sum((F.least(n_r, n_h) - right) * F.col("_d")).alias("confusion"),
    )
    return total.withColumn("der", (F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.greatest(F.lit(1e-9), F.col("reference_time").cast("double")))
