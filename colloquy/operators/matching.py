"""Joins by score: vectors against profiles, look-back and look-ahead windows, nearest anchors, retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .dialogue import robust_centroid

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, and ``size`` bytes as JSON."""
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """The L2-normalised mean per key; null if lengths differ or the norm is next to nothing."""
    parts = df.where(F.col(vector).isNotNull()).select(*keys, F.size(vector).alias("_n"), F.posexplode(F.col(vector).cast("array<double>")).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"), F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    one = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_v"), F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_norm"), F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return one.select(*keys, F.when((F.col("_a") == F.col("_b")) & (F.col("_norm") > 1e-8), F.transform("_v", lambda x: x / F.col("_norm"))).alias("mean"))


def match_profiles(vectors: DataFrame, profiles: DataFrame, id_col: str, vector: str, threshold: float = 0.55, margin: float = 0.08) -> DataFrame:
    """Best profile per vector: .75 of the prototype's score and .25 of the mean of its three best references.

    profiles: profile_id, prototype, references.  Accepted if the score is at least
    ``threshold`` and leads the second by ``margin``; ties go to the smaller profile_id.
    The profiles are a reference list; they are broadcast only while they are few.
    """
    p = bounded(profiles.select("profile_id", "prototype", "references"))
    scored = vectors.select(id_col, vector).join(p)
    refs = F.slice(F.sort_array(F.transform("references", lambda r: S.dot(F.col(vector), r)), asc=False), 1, 3)
    best3 = F.when(F.size(refs) > 0, F.aggregate(refs, F.lit(0.0), lambda a, x: a + x) / F.size(refs)).otherwise(S.dot(vector, "prototype"))
    scored = scored.select(id_col, "profile_id", (0.75 * S.dot(vector, "prototype") + 0.25 * best3).alias("score"))
    top = scored.groupBy(id_col).agg(F.max_by("profile_id", F.struct("score", (-F.col("profile_id")).alias("t"))).alias("profile_id"), F.max("score").alias("score"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 2, 1).alias("_two"))
    second = F.coalesce(F.get("_two", F.lit(0)), F.lit(-1.0))
    lead = F.col("score") - second
    return top.select(id_col, "profile_id", "score", lead.alias("margin"), ((F.col("score") >= threshold) & (lead >= margin)).alias("accepted"))


SURE_SCORE, SURE_MARGIN = 0.08, 0.04  # beyond threshold and margin, of a match that speaks for others of its session


def match_sessions(vectors: DataFrame, profiles: DataFrame, keys: Sequence[str], id_col: str, vector: str, threshold: float = 0.55, margin: float = 0.08) -> DataFrame:
    """``match_profiles`` and a second pass: (keys, id, profile_id, score, margin, accepted, session_prototype).

    Matches that are well apart say how a profile sounds in their session: the mean of its prototype and of their robust
    centroid.  Vectors that matched nothing are compared with these; ties go to the larger profile_id.  A session's
    prototypes stay in it.
    """
    first = vectors.select(*keys, id_col, vector).join(match_profiles(vectors, profiles, id_col, vector, threshold, margin), id_col)
    sure = first.where(F.col("accepted") & (F.col("score") >= threshold + SURE_SCORE) & (F.col("margin") >= margin + SURE_MARGIN))
    heard = robust_centroid(sure, [*keys, "profile_id"], vector).join(bounded(profiles.select("profile_id", F.col("prototype").cast("array<double>").alias("_p"))), "profile_id").where("centroid is not null")
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.lit(1e-12), F.sqrt(S.dot(v, v))))
    both = heard.withColumn("_p", unit(F.col("_p"))).withColumn("_m", F.zip_with("_p", "centroid", lambda a, b: (a + b) / 2))
    prototypes = both.select(*keys, F.col("profile_id").alias("_profile"), unit(F.col("_m")).alias("_m"))
    again = first.where(~F.col("accepted")).join(prototypes, list(keys)).withColumn("_s", S.dot(F.col(vector), F.col("_m")))
    w = Window.partitionBy(*keys, id_col).orderBy(F.desc("_s"), F.desc("_profile"))
    ranked = again.withColumn("_k", F.row_number().over(w)).withColumn("_lead", F.col("_s") - F.coalesce(F.lead("_s").over(w), F.lit(-1.0))).where("_k = 1")
    found = ranked.where((F.col("_s") >= threshold) & (F.col("_lead") >= margin)).select(*keys, id_col, F.struct("_profile", "_s", "_lead").alias("_n"))
    out = first.join(found, [*keys, id_col], "left")
    new = F.col("_n").isNotNull()
    pick = lambda old, name: F.when(new, F.col(f"_n.{name}")).otherwise(F.col(old)).alias(old)
    return out.select(*keys, id_col, pick("profile_id", "_profile"), pick("score", "_s"), pick("margin", "_lead"), (F.col("accepted") | new).alias("accepted"), new.alias("session_prototype"))


def look_back(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, payload: Sequence[str]) -> DataFrame:
    """Each row with each of its ``rows`` predecessors: columns p_*, and distance."""
    n = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    past = n.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("_n").alias("_m"), *[F.col(c).alias(f"p_{c}") for c in payload])
    spread = n.withColumn("_at", F.explode(F.sequence(F.lit(1), F.lit(rows))))
    cond = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys] + [F.col("_n") - F.col("_at") == F.col("_m")]
    return spread.join(past, cond).withColumnRenamed("_at", "distance").drop("_n", "_m", *[f"_k{k}" for k in keys])


def look_ahead(anchors: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, horizon, payload: Sequence[str], closed: bool = False) -> DataFrame:
    """Each anchor with the rows that come at most ``horizon`` after it (``closed``: or at its time): columns n_*, by buckets of that width."""
    a = anchors.withColumn("_b", F.floor(F.col(time) / horizon)).withColumn("_b", F.explode(F.array("_b", F.col("_b") + 1)))
    r = rows.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col(time).alias("n_time"), F.floor(F.col(time) / horizon).alias("_c"), *[F.col(c).alias(f"n_{c}") for c in payload])
    cond = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys] + [F.col("_b") == F.col("_c"), (F.col("n_time") >= F.col(time)) if closed else (F.col("n_time") > F.col(time)), F.col("n_time") - F.col(time) <= horizon]
    return a.join(r, cond).drop("_b", "_c", *[f"_k{k}" for k in keys])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def nearest_anchor(rows: DataFrame, anchors: DataFrame, keys: Sequence[str], time: str, anchor: str) -> DataFrame:
    """The anchor nearest in time to each row (earlier on ties), by one sort: last before and first after."""
    a = anchors.select(*keys, F.col(time).alias("_t"), F.col(anchor).alias("_a"), F.lit(0).alias("_kind"))
    r = rows.withColumn("_row", F.struct(*rows.columns))
    both = a.withColumn("_row", F.lit(None).cast(r.schema["_row"].dataType)).unionByName(r.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), F.lit(1).alias("_kind"), "_row"))
    point = F.when(F.col("_kind") == 0, F.struct("_t", "_a"))
    w = Window.partitionBy(*keys).orderBy("_t", "_kind", "_a")
    back = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), "_kind", F.col("_a").desc())
    # of anchors at one time the smallest counts on either side
    firsts = F.min("_a").over(Window.partitionBy(*keys, "_t", "_kind"))
    both = both.withColumn("_a", F.when(F.col("_kind") == 0, firsts))
    both = both.withColumn("_before", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_after", F.last(point, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    d0, d1 = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    near = F.when(F.col("_after").isNull() | (d0 <= d1), F.col("_before")).otherwise(F.col("_after"))
    return both.where("_kind = 1").select("_row.*", near["_a"].alias("anchor"), F.abs(F.col("_t") - near["_t"]).alias("distance"))


def retrieve(claims: DataFrame, question: str, query_vector: Sequence[float] | None = None, limit: int = 12, revision: int = 0) -> DataFrame:
    """The best claims for a question: 3 lexical + 2 entity + 2 dense + state + recency, over .25, one per proposition.

    claims: claim_id, proposition_id, statement, start, lifecycle, project_revision, entity_names, embedding.
    """
    query = S.tokens(F.lit(question))
    lexical = F.size(F.array_intersect(query, S.tokens("statement"))) / F.greatest(F.lit(1), F.size(query))
    names = F.transform(F.coalesce("entity_names", F.array().cast("array<string>")), S.fold)
    entity = F.when(F.size(names) > 0, F.size(F.filter(query, lambda q: F.exists(names, lambda n: n.contains(q)))) / F.greatest(F.lit(1), F.size(query))).otherwise(0.0)
    dense = S.cosine(F.array(*[F.lit(float(x)) for x in query_vector]), F.col("embedding")) if query_vector else F.lit(0.0)
    state = F.when(F.coalesce("lifecycle", F.lit("active")) == "active", 1.0).otherwise(0.2)
    recency = 1 / (1 + F.greatest(F.lit(0), F.lit(revision) - F.coalesce("project_revision", F.lit(0))))
    scored = claims.withColumn("score", 3 * lexical + 2 * entity + 2 * dense + state + recency).where("score > 0.25")
    order = [F.col("score").desc(), F.col("start").desc(), F.col("claim_id")]
    best = scored.groupBy("proposition_id").agg(F.max_by(F.struct(*scored.columns), F.struct("score", "start", F.col("claim_id"))).alias("_r"))
    return best.select("_r.*").orderBy(*order).limit(limit)


def answer_candidates(questions: DataFrame, events: DataFrame, keys: Sequence[str], window: float = 180.0, limit: int = 8) -> DataFrame:
    """Events up to ``window`` after a question: .55 for an answer or assertion (a quarter of it for others), .30 for the share of its words, .15 for recency; the best ``limit``."""
    found = look_ahead(questions, events, keys, "start", window, ["event_id", "text", "act"], closed=True)
    act = F.when(F.col("n_act").isin("answer", "assert"), 1.0).otherwise(0.25)
    asked = S.tokens("text")
    shared = F.size(F.array_intersect(asked, S.tokens("n_text"))) / F.greatest(F.lit(1), F.size(asked))
    score = 0.55 * act + 0.30 * shared + 0.15 * (1 - (F.col("n_time") - F.col("start")) / window)
    return top_per(found.withColumn("score", F.round(score, 12)), [*keys, "event_id"], [F.col("score").desc(), F.col("n_time"), F.col("n_event_id")], limit)
