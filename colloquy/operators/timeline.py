"""One speaker for every stretch of time: voice matches arbitrate between two tracks, short islands inherit, equal neighbours join.

segments: keys, pos, start, end, clusters, candidates, primary, verifier_mapped (arrays), agreement, overlap.
matches: keys, cluster, profile_id, name, score, margin, session_prototype.
local: keys, pos, profile_id, name, score, margin: segments that were decided on their own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .sequence import Fold, fold

WHO = "struct<id:string,name:string,score:double,margin:double,known:boolean,prototype:boolean>"
SPOKEN = "start double, end double, speaker_id string, speaker_name string, known_speaker boolean, confidence double, confidence_level string, overlap boolean, decision string, clusters array<string>, n_segments int"
EPSILON = 1e-6


def identities(segments: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each cluster of a recording with ``who``: its matched profile, or UNKNOWN_n in order of first appearance."""
    all_of = F.array_distinct(F.concat("candidates", "primary", "verifier_mapped", "clusters"))
    met = segments.select(*keys, "pos", F.posexplode(all_of).alias("_k", "cluster")).groupBy(*keys, "cluster").agg(F.min(F.struct("pos", "_k")).alias("_at"))
    m = matches.select(*keys, "cluster", F.col("profile_id").alias("_p"), "name", F.col("score").cast("double").alias("score"), F.col("margin").cast("double").alias("margin"), F.coalesce("session_prototype", F.lit(False)).alias("_s"))
    met = met.join(m, [*keys, "cluster"], "left")
    n = F.row_number().over(Window.partitionBy(*keys, F.col("_p").isNull()).orderBy("_at"))
    known = F.col("_p").isNotNull()
    label = F.when(known, F.concat(F.lit("profile:"), "_p")).otherwise(F.concat(F.lit("UNKNOWN_"), n))
    zero = F.lit(0.0)
    who = F.struct(label.alias("id"), F.when(known, F.col("name")).otherwise(label).alias("name"), F.when(known, F.col("score")).otherwise(zero).alias("score"), F.when(known, F.col("margin")).otherwise(zero).alias("margin"), known.alias("known"), F.coalesce("_s", F.lit(False)).alias("prototype"))
    return met.select(*keys, "cluster", who.cast(WHO).alias("who"))


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "HIGH").when(confidence >= 0.7, "MEDIUM").otherwise("LOW")


def decided(segments: DataFrame, matches: DataFrame, keys: Sequence[str], local: DataFrame | None = None, short: float = 1.5, calibrated: Column | None = None) -> DataFrame:
    """A row for every speaker of every segment, and why.

    A local decision comes first, then what both tracks say, then voices: the same person on both, a known one on
    either, the verifier's in a short segment; else the primary track. ``calibrated`` (over score, margin, agreement, duration, bucket)
    takes the place of the confidence where it isn't null.
    """
    who = identities(segments, matches, keys)
    all_of = F.array_distinct(F.concat("candidates", "primary", "verifier_mapped", "clusters"))
    per = segments.select(*keys, "pos", F.explode(all_of).alias("cluster")).join(who, [*keys, "cluster"]).groupBy(*keys, "pos").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "who"))).alias("_who"))
    s = segments.join(per, [*keys, "pos"], "left")
    if local is not None:
        one = F.struct(F.concat(F.lit("profile:"), "profile_id").alias("id"), "name", F.col("score").cast("double"), F.col("margin").cast("double"), F.lit(True).alias("known"), F.lit(False).alias("prototype")).cast(WHO)
        s = s.join(local.select(*keys, "pos", one.alias("_local"), F.col("profile_id").alias("_profile")), [*keys, "pos"], "left")
    else:
        s = s.withColumn("_local", F.lit(None).cast(WHO)).withColumn("_profile", F.lit(None).cast("string"))
    ids = lambda c: F.array_distinct(F.transform(F.filter(F.col(c), lambda x: F.col("_who")[x]["known"]), lambda x: F.col("_who")[x]["id"]))
    s = s.withColumn("_p", ids("primary")).withColumn("_v", ids("verifier_mapped")).withColumn("_agreed", F.array_sort(F.array_intersect("primary", "verifier_mapped")))
    one = lambda c: F.size(c) > 0
    same = one("_p") & one("_v") & (F.size(F.array_except("_p", "_v")) == 0) & (F.size(F.array_except("_v", "_p")) == 0)
    brief = (F.col("end") - F.col("start") <= short) & one("_p") & one("_v")
    person = F.slice(F.filter("candidates", lambda x: F.array_contains(F.col("_p"), F.col("_who")[x]["id"])), 1, 1)
    mine = F.filter("candidates", lambda x: F.col("_who")[x]["id"] == F.col("_local.id"))
    ahead = F.when(one(mine), F.slice(mine, 1, 1)).otherwise(F.array(F.concat(F.lit("local:"), "_profile")))
    rest = F.when(one("primary"), F.col("primary")).when(one("verifier_mapped"), F.col("verifier_mapped")).otherwise(F.col("clusters"))
    rules = (
        ("redimnet_second_pass", F.col("_local").isNotNull(), ahead), ("diarizers_agree", one("_agreed"), F.col("_agreed")), ("voice_id_resolved_same_person", same, person), ("voice_id_primary", one("_p") & ~one("_v"), F.col("primary")),
        ("voice_id_verifier", one("_v") & ~one("_p"), F.col("verifier_mapped")), ("short_turn_verifier", brief, F.col("verifier_mapped")), ("primary_low_confidence", F.lit(True), rest),
    )
    picked = None
    for name, holds, chosen in rules:
        pair = F.struct(F.lit(name).alias("decision"), chosen.alias("chosen"))
        picked = F.when(holds, pair) if picked is None else picked.when(holds, pair)
    s = s.withColumn("_d", picked)
    found = F.transform("_d.chosen", lambda c: F.struct(c.alias("cluster"), F.coalesce(F.col("_who")[c], F.col("_local")).alias("who")))
    s = s.withColumn("_f", found).withColumn("_f", F.filter("_f", lambda x, k: F.array_position(F.transform(F.col("_f"), lambda y: y["who"]["id"]), x["who"]["id"]) == k + 1))
    r = s.select(*keys, "pos", "start", "end", "agreement", "overlap", "primary", "verifier_mapped", F.col("_d.decision").alias("decision"), F.posexplode("_f").alias("_k", "_x")).select("*", "_x.cluster", "_x.who.*")
    duration = F.col("end") - F.col("start")
    r = r.withColumn("bucket", S.voice_bucket(duration, "overlap", F.lit(False), "prototype", F.col("decision") == "redimnet_second_pass")).withColumn("duration", duration)
    full, voice, apart = F.col("agreement") >= 0.99, F.greatest(F.lit(0.0), "score"), F.least(F.lit(1.0), F.col("margin") / 0.2)
    plain = F.when(F.col("decision") == "primary_low_confidence", 0.58).when(F.col("known") & full, F.least(F.lit(0.99), 0.70 + 0.20 * voice + 0.09 * apart)).when(F.col("known"), F.least(F.lit(0.89), 0.58 + 0.22 * voice + 0.07 * apart)).when(full, 0.72).otherwise(0.45)
    r = r.withColumn("_c", plain if calibrated is None else F.coalesce(calibrated, plain))
    return r.select(
        *keys, "pos", F.col("_k").alias("place"), "start", "end", F.col("id").alias("speaker_id"), F.col("name").alias("speaker_name"), "cluster", F.col("known").alias("known_speaker"), F.round("_c", 4).alias("confidence"), level(F.col("_c")).alias("confidence_level"),
        F.coalesce("overlap", F.lit(False)).alias("overlap"), "decision", "primary", "verifier_mapped", "bucket",
    )


class Spoken(Fold):
    """Rows in order of start, end and speaker: short doubtful ones take over from neighbours that agree, then equal neighbours join.

    A row sees what those before it have become, and those after it as they came.  Held are the rows that wait for
    the first one that starts at their end, and of those before only the last that has ended and those that have not.
    """

    def __init__(self, short: float = 1.5, tolerance: float = 0.3) -> None:
        self.short, self.tolerance = short, tolerance
        self.waiting: deque[dict] = deque()
        self.running: list[tuple[int, dict]] = []
        self.ended: tuple[int, dict] | None = None
        self.n, self.last = 0, None

    def doubtful(self, r: dict) -> bool:
        return not r["overlap"] and r["end"] - r["start"] <= self.short and not (r["known_speaker"] and r["confidence_level"] != "LOW")

    def inherit(self, r: dict, after: dict | None) -> None:
        self.retire(r["start"])
        before = self.ended[1] if self.ended else None
        near = [x for x in (before, after) if x and x["known_speaker"] and not x["overlap"]]
        on_track = [x for x in near if any(set(r[t] or ()) & set(x[t] or ()) for t in ("primary", "verifier_mapped"))]
        if on_track and len({x["speaker_id"] for x in on_track}) == 1:
            source = on_track[0]
        elif len(near) == 2 and before["speaker_id"] == after["speaker_id"]:
            source = before
        else:
            return
        r |= {k: source[k] for k in ("speaker_id", "speaker_name", "known_speaker")} | {"confidence": 0.74, "confidence_level": "MEDIUM", "decision": "short_turn_context"}

    def join(self, r: dict) -> Iterable[dict]:
        last = self.last
        if last and r["speaker_id"] == last["speaker_id"] and r["overlap"] == last["overlap"] and r["start"] - last["end"] <= self.tolerance:
            c = min(last["confidence"], r["confidence"])
            last |= {"end": max(last["end"], r["end"]), "confidence": c, "confidence_level": "HIGH" if c >= 0.9 else "MEDIUM" if c >= 0.7 else "LOW", "clusters": sorted({*last["clusters"], r["cluster"]}), "n_segments": last["n_segments"] + 1}
            return ()
        done = [last] if last else []
        self.last = {k: r[k] for k in ("start", "end", "speaker_id", "speaker_name", "known_speaker", "confidence", "confidence_level", "overlap", "decision")} | {"clusters": [r["cluster"]], "n_segments": 1}
        return done

    def drain(self, over: bool) -> Iterable[dict]:
        out: list[dict] = []
        while self.waiting:
            r = self.waiting[0]
            if self.doubtful(r):
                after = next((x for x in self.waiting if x is not r and x["start"] >= r["end"] - EPSILON), None)
                if after is None and not over:
                    break
                self.inherit(r, after)
            self.waiting.popleft()
            self.running.append((self.n, r))
            self.n += 1
            if len(self.running) > 64:  # drop those that ended before
                self.retire(r["start"])
            out += self.join(r)
        return out

    def retire(self, now: float) -> None:
        for x in [x for x in self.running if x[1]["end"] <= now + EPSILON]:
            self.running.remove(x)
            self.ended = max(self.ended or x, x, key=lambda y: y[0])

    def row(self, r: dict) -> Iterable[dict]:
        self.waiting.append(dict(r))
        return self.drain(False)

    def end(self) -> Iterable[dict]:
        return [*self.drain(True), *([self.last] if self.last else [])]


def resolve(segments: DataFrame, matches: DataFrame, keys: Sequence[str], local: DataFrame | None = None, short: float = 1.5, tolerance: float = 0.3, calibrated: Column | None = None) -> DataFrame:
    """The timeline of each recording: who spoke when, how sure, why, and under which clusters."""
    rows = decided(segments, matches, keys, local, short, calibrated)
    return fold(rows, keys, ["start", "end", "speaker_id", "pos", "place"], lambda: Spoken(short, tolerance), SPOKEN)
