"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def calibration_bins(df: DataFrame, confidence: str, correct: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ten bins: n, mean confidence, share of correct ones."""
    bin_ = F.least(F.lit(9), F.floor(F.col(confidence) * 10)).cast("int")
    return df.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("int")).alias("accuracy"))


def calibration(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """ece and brier; both 0 for no rows."""
    bins = calibration_bins(df, confidence, correct)
    ece = bins.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n"), F.lit(0.0)).alias("ece"))
    brier = df.agg(F.coalesce(F.avg(F.pow(F.col(confidence) - F.col(correct).cast("int"), 2)), F.lit(0.0)).alias("brier"))
    return ece.join(brier)


def set_metrics(gold: DataFrame, predicted: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Set precision, recall and F1 of distinct keys."""
    g = gold.select(*by, key).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*by, key).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, [*by, key], "full")
    n = both.groupBy(*by).agg(F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    return n.select(*by, "tp", "fp", "fn", S.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("_m")).select(*by, "tp", "fp", "fn", "_m.*")


def public_metrics(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Mandatory recall, precision, episode coverage and unsupported claims.  Both: claim_id, episode_id; expected: mandatory."""
    e = expected.groupBy("claim_id").agg(F.bool_or("mandatory").alias("_m"))
    p = produced.select("claim_id").distinct().withColumn("_p", F.lit(1))
    both = e.withColumn("_e", F.lit(1)).join(p, "claim_id", "full")
    part = lambda a, b: F.count_if(a) / F.greatest(F.lit(1), F.count_if(b))
    m, has_e, has_p = F.coalesce("_m", F.lit(False)), F.col("_e").isNotNull(), F.col("_p").isNotNull()
    claims = both.agg(part(m & has_p, m).alias("mandatory_claim_recall"), part(has_e & has_p, has_p).alias("atomic_public_precision"), F.array_sort(F.collect_list(F.when(~has_e, F.col("claim_id")))).alias("unsupported_claims"))
    ep = expected.where("episode_id is not null").select("episode_id").distinct()
    cov = produced.where("episode_id is not null").select("episode_id").distinct().withColumn("_c", F.lit(1))
    return claims.join(ep.join(cov, "episode_id", "left").agg((F.count("_c") / F.greatest(F.lit(1), F.count("*"))).alias("episode_coverage")))


def release_gate(metrics: DataFrame, policy: dict[str, tuple[str, float]]) -> DataFrame:
    """failures and passed; policy: metric to (max or min, limit); a missing metric counts as 0."""
    fails = []
    for name, (kind, limit) in policy.items():
        v = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in metrics.columns else F.lit(0.0)
        fails.append(F.when(v > limit if kind == "max" else v < limit, F.lit(name)))
    return metrics.withColumn("failures", F.array_compact(F.array(*fails))).withColumn("passed", F.size("failures") == 0)


#: fixed values: the release policy
RELEASE_POLICY = {"decision_false_positive": ("max", 0.01), "question_false_resolution": ("max", 0.02), "public_factual_precision": ("min", 0.99), "importance_weighted_recall_regression": ("max", 0.02)}


def word_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance over arrays of words: each distinct word of a row as one character (from U+10000 on)."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (left, right))
    letter = lambda known, w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")
    coded = lambda row, side: F.array_join(F.transform(row[side], lambda w: letter(row["known"], w)), "")
    row = F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("known"))
    return F.get(F.transform(F.array(row), lambda r: F.levenshtein(coded(r, "a"), coded(r, "b"))), F.lit(0))


def text_scores(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """wer, cer and whether numbers and technical tokens differ, per row."""
    r, h = S.squeezed(reference), S.squeezed(hypothesis)
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    out = df.withColumn("_r", r).withColumn("_h", h)
    return out.select(
        *df.columns,
        (word_distance(words(F.col("_r")), words(F.col("_h"))) / F.greatest(F.lit(1), F.size(words(F.col("_r"))))).alias("wer"),
        (F.levenshtein(F.replace("_r", F.lit(" ")), F.replace("_h", F.lit(" "))) / F.greatest(F.lit(1), F.length(F.replace("_r", F.lit(" "))))).alias("cer"),
        (F.array_sort(S.numeric_tokens(reference)) != F.array_sort(S.numeric_tokens(hypothesis))).cast("int").alias("number_error"),
        (F.array_sort(S.technical_tokens(reference)) != F.array_sort(S.technical_tokens(hypothesis))).cast("int").alias("technical_error"),
    )


def aligned_scores(reference: DataFrame, hypothesis: DataFrame, alignment: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Claim precision, recall and F1 through an explicit alignment (reference_id, hypothesis_id, supported), and agreement of fields."""
    pairs = alignment.where("supported").join(reference.select(F.col("record_id").alias("reference_id"), *[F.col(f).alias(f"_r_{f}") for f in fields]), "reference_id").join(hypothesis.select(F.col("record_id").alias("hypothesis_id"), *[F.col(f).alias(f"_h_{f}") for f in fields]), "hypothesis_id")
    agree = [F.coalesce(F.avg(F.col(f"_r_{f}").eqNullSafe(F.col(f"_h_{f}")).cast("int")), F.lit(0.0)).alias(f"{f}_agreement") for f in fields]
    got = pairs.agg(F.count_distinct("reference_id").alias("_tr"), F.count_distinct("hypothesis_id").alias("_th"), *agree)
    n = reference.agg(F.count("*").alias("_nr")).join(hypothesis.agg(F.count("*").alias("_nh")))
    p, r = F.col("_th") / F.greatest(F.lit(1), F.col("_nh")), F.col("_tr") / F.greatest(F.lit(1), F.col("_nr"))
    return got.join(n).select(p.alias("claim_precision"), r.alias("claim_recall"), (2 * p * r / F.greatest(F.lit(1e-12), p + r)).alias("claim_f1"), *[f"{f}_agreement" for f in fields])


def _assigned(worth: np.ndarray) -> list[tuple[int, int]]:
    """Rows to columns with the largest total worth: shortest augmenting paths over reduced costs."""
    turned = worth.shape[0] > worth.shape[1]
    cost = -(worth.T if turned else worth)
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        near, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = i, -1
        while True:
            step = cost[row] - row_price[row] - column_price + (near[last] if last >= 0 else 0.0)
            closer = ~done & (step < near)
            near[closer], came[closer] = step[closer], last
            last = int(np.argmin(np.where(done, np.inf, near)))
            done[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        end = near[last]
        row_price[i] += end
        for j in np.flatnonzero(done):
            if j != last:
                row_price[owner[j]] += end - near[j]
                column_price[j] -= end - near[j]
        while last >= 0:
            previous = came[last]
            owner[last] = owner[previous] if previous >= 0 else i
            last = previous
    return [(j, int(o)) if turned else (int(o), j) for j, o in enumerate(owner.tolist()) if o >= 0]


def best_assignment(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one-to-one mapping of labels (left, right, score) with the largest total, per key; pairs without a score stay apart.

    Exact: by dynamic programming over sets up to 12 labels a side, where ties go to the earlier labels, and by
    augmenting paths (n^3) beyond.
    """
    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(pdf["left"].unique()), sorted(pdf["right"].unique())
        score = {(a, b): s for a, b, s in zip(pdf["left"], pdf["right"], pdf["score"], strict=True)}
        first = {k: pdf[k].iloc[0] for k in keys}
        if len(left) > 12 or len(right) > 12:
            pairs_ = [(left[i], right[j]) for i, j in _assigned(np.array([[max(0.0, score.get((a, b), 0.0)) for b in right] for a in left]))]
            return pd.DataFrame([{**first, "left": a, "right": b, "score": score[a, b]} for a, b in pairs_ if score.get((a, b), 0.0) > 0], columns=[*keys, "left", "right", "score"])
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for a in left:
            new = dict(best)
            for mask, (total, chosen) in best.items():
                for j, b in enumerate(right):
                    s = score.get((a, b), 0.0)
                    if not mask >> j & 1 and s > 0:
                        m = mask | 1 << j
                        if m not in new or total + s > new[m][0] + 1e-12:
                            new[m] = (total + s, (*chosen, (a, b, s)))
            best = new
        chosen = max(best.values(), key=lambda x: x[0])[1]
        return pd.DataFrame([{**first, "left": a, "right": b, "score": s} for a, b, s in chosen], columns=[*keys, "left", "right", "score"])

    return pairs.select(*keys, "left", "right", "score").groupBy(*keys).applyInPandas(solve, f"{fields}{', ' if fields else ''}`left` string, `right` string, score double")


def macro_averages(scores: DataFrame, system: str, metrics: Sequence[str], baseline: str, candidate: str, worse_by: float = 0.0) -> DataFrame:
    """Means per metric of baseline and candidate, their difference, and whether the candidate is worse (metrics are errors)."""
    long = scores.unpivot([system], list(metrics), "metric", "value")
    out = long.groupBy("metric").agg(F.avg(F.when(F.col(system) == baseline, F.col("value"))).alias("baseline"), F.avg(F.when(F.col(system) == candidate, F.col("value"))).alias("candidate"))
    return out.withColumn("delta", F.col("candidate") - F.col("baseline")).withColumn("regression", F.col("delta") > worse_by)


def hard_negatives(claims: DataFrame, statement: str) -> DataFrame:
    """Corrupted copies of claims: other number, flipped negation, other modality (kind, corrupted); only those that differ."""
    s = F.col(statement)
    made = F.array(
        F.struct(F.lit("number").alias("kind"), F.regexp_replace(s, "(\\d+)", "9$1").alias("corrupted")),
        F.struct(F.lit("negation").alias("kind"), F.when(s.rlike("(?iuU)\\bне\\b"), F.regexp_replace(s, "(?iuU)\\bне\\s+", "")).otherwise(F.concat(F.lit("не "), s)).alias("corrupted")),
        F.struct(F.lit("modality").alias("kind"), F.regexp_replace(s, "(?iuU)\\b(?:возможно|можно)\\b", "обязательно").alias("corrupted")),
    )
    return claims.select("*", F.explode(made).alias("_c")).select(*claims.columns, "_c.*").where(F.col("corrupted") != s)

