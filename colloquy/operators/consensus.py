"""Two speaker tracks to one timeline: snapped endpoints, mapped labels, agreement per segment.

tracks: keys, start, end, speaker.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation, intervals
from .sequence import Fold, fold, islands

CONFIDENCE = {"agreement": 0.96, "partial_agreement": 0.78, "disagreement": 0.45}


class Snap(Fold):
    """Points in order to groups that reach at most ``tolerance`` from their first; each goes to its group's upper median."""

    def __init__(self, tolerance: float) -> None:
        self.tolerance, self.group = tolerance, []

    def row(self, r: dict) -> Iterable[dict]:
        p = r["point"]
        if self.group and p - self.group[0] > self.tolerance:
            done = list(self.end())
            self.group = [p]
            return done
        self.group.append(p)
        return ()

    def end(self) -> Iterable[dict]:
        return [{"point": p, "snapped": self.group[len(self.group) // 2]} for p in self.group]


def track_matrix(primary: DataFrame, verifier: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """(keys, left, right, intersection, iou, score) of each pair of labels that meet: .5 IoU + .25 coverage of either."""
    a = intervals.union(primary.withColumn("left", F.col("speaker")), [*keys, "left"])
    b = intervals.union(verifier.withColumn("right", F.col("speaker")), [*keys, "right"])
    da = a.groupBy(*keys, "left").agg(F.sum(F.col("end") - F.col("start")).alias("_da"))
    db = b.groupBy(*keys, "right").agg(F.sum(F.col("end") - F.col("start")).alias("_db"))
    met = intervals.interval_join(a, b, keys, width).groupBy(*keys, "left", F.col("r_right").alias("right")).agg(F.sum(intervals.overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))).alias("intersection"))
    j = met.join(da, [*keys, "left"]).join(db, [*keys, "right"])
    tiny = F.lit(1e-9)
    iou = F.col("intersection") / F.greatest(tiny, F.col("_da") + F.col("_db") - F.col("intersection"))
    score = 0.5 * iou + 0.25 * F.col("intersection") / F.greatest(tiny, F.col("_da")) + 0.25 * F.col("intersection") / F.greatest(tiny, F.col("_db"))
    return j.select(*keys, "left", "right", "intersection", iou.alias("iou"), score.alias("score"))


def consensus(primary: DataFrame, verifier: DataFrame, keys: Sequence[str], tolerance: float = 0.3, width: float = 10.0) -> DataFrame:
    """Segments with clusters, candidates, primary, verifier_mapped, agreement, confidence, overlap and decision; equal neighbours are joined."""
    cols = [*keys, "start", "end", "speaker"]
    rounded = lambda df, t: df.select(*keys, F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), F.col("speaker").cast("string").alias("speaker"), F.lit(t).alias("track"))
    both = rounded(primary, "p").unionByName(rounded(verifier, "v"))
    points = both.select(*keys, F.explode(F.array("start", "end")).alias("point")).distinct()
    snapped = fold(points, keys, ["point"], lambda: Snap(tolerance), "point double, snapped double")
    for end in ("start", "end"):
        both = both.join(snapped.select(*keys, F.col("point").alias(end), F.col("snapped").alias(f"_{end}")), [*keys, end])
    lost = (F.col("_end") <= F.col("_start")) & (F.col("end") > F.col("start"))  # too short to be snapped
    both = both.select(*keys, F.when(lost, F.col("start")).otherwise(F.col("_start")).alias("start"), F.when(lost, F.col("end")).otherwise(F.col("_end")).alias("end"), "speaker", "track").where("end > start")
    p, v = (both.where(F.col("track") == t).select(*cols) for t in "pv")
    pairs = track_matrix(p, v, keys, width)
    mapping = evaluation.best_assignment(pairs, keys).select(*keys, F.col("right").alias("speaker"), F.col("left").alias("_to"))
    mapped = v.join(mapping, [*keys, "speaker"], "left").select(*keys, "start", "end", F.concat(F.lit("v:"), F.coalesce("_to", F.concat(F.lit("other:"), F.col("speaker")))).alias("speaker"))
    seg = intervals.atomic_segments(p.withColumn("speaker", F.concat(F.lit("p:"), "speaker")).unionByName(mapped), keys, "speaker", width)
    pick = lambda t: F.transform(F.filter("labels", lambda x: x.startswith(t)), lambda x: F.substr(x, F.lit(3)))
    seg = seg.where(F.col("end") - F.col("start") > 1e-4).withColumn("primary", pick("p:")).withColumn("verifier_mapped", pick("v:"))
    agreed, union = F.array_intersect("primary", "verifier_mapped"), F.array_sort(F.array_union("primary", "verifier_mapped"))
    decision = F.when(F.size(agreed) == F.size(union), "agreement").when(F.size(agreed) > 0, "partial_agreement").otherwise("disagreement")
    clusters = F.when(F.size(agreed) > 0, union).when(F.size("primary") > 0, F.col("primary")).otherwise(F.col("verifier_mapped"))
    seg = seg.select(*keys, "start", "end", clusters.alias("clusters"), union.alias("candidates"), "primary", "verifier_mapped", F.bround(F.size(agreed) / F.greatest(F.lit(1), F.size(union)), 3).alias("agreement"), decision.alias("decision"), ((F.size("primary") > 1) | (F.size("verifier_mapped") > 1)).alias("overlap"))
    w = Window.partitionBy(*keys).orderBy("start")
    same = F.struct("clusters", "primary", "verifier_mapped", "decision", "overlap")
    cut = (F.row_number().over(w) == 1) | (same != F.lag(same).over(w)) | (F.col("start") - F.lag("end").over(w) > tolerance)
    out = islands(seg, keys, ["start"], cut).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.first(c).alias(c) for c in ("clusters", "candidates", "primary", "verifier_mapped", "agreement", "decision", "overlap")])
    table = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return out.drop("island").withColumn("confidence", F.element_at(table, F.col("decision"))).withColumn("confidence_level", F.when(F.col("confidence") >= 0.9, "HIGH").when(F.col("confidence") >= 0.7, "MEDIUM").otherwise("LOW"))
