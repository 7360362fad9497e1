"""Toxicity by maximum-scoring segments.

Token log-odds come from documents' labels: for each feature (a word, and with
PREFIXES its first letters) the log-odds of occurring in a toxic document with an
informative Dirichlet prior, and its z-score (root of the likelihood ratio).  A token scores by its feature of
largest z-score; without a significant one it costs DRIFT.  A linear-time scan
finds all maximal scoring segments of a whole text; under a Gumbel law fitted on
clean documents each gets a significance, and the evidence of the significant
ones, with that of the best, gives a calibrated probability.

Learning uses rows with crc32(doc_id as text) mod 5 <> 0: remainders 1 to 3 give
the log-odds, 4 the Gumbel law and the calibration; after that the log-odds are
counted over both.  Of each, at most SAMPLE
labelled rows per label (those of smallest hash of the doc_id; texts that occur
several times count once) are used; scoring covers every whole text.

Defined results: null and empty texts score like a text without evidence; with
no labels to learn from nothing is predicted toxic (every score is 0.25).  A
doc_id, or a text, with both labels teaches nothing; a text in both parts counts
in the first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, ship, stored

SAMPLE = 4_000  # labelled rows of each label for the log-odds, and for the calibration
PREFIXES: tuple[int, ...] = ()  # lengths of beginnings of words that are features too; none did better on validation rows
Z_MIN = 4.0
Z_NONE = 2.5  # log-odds shrink to nothing as z falls to this
DRIFT = -0.15  # of a token without evidence
SIGNIFICANT = 0.05
CLEAN_FLOOR = 1e-12
PRIOR = 20.0  # documents that the Dirichlet prior is worth
HELD_WORDS = 200_000  # words whose weights a task remembers
COUNTED = 150_000  # counts a task holds before it hands them on

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence that is ``drift`` everywhere but at ``scores``.

    Linear in the number of scored positions: runs of drift are taken in one step.
    """
    stack: list[tuple[float, float, int, int]] = []  # total before, total after, start, end
    total, at = 0.0, 0
    for pos, s in scores:
        total += drift * (pos - at)
        at = pos + 1
        if s <= 0:
            total += s
            continue
        left, start = total, pos
        total += s
        right = total
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k -= 1
            if k < 0 or stack[k][1] >= right:
                break
            left, start = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((left, right, start, pos + 1))
    return [(b - a, s, e) for a, b, s, e in stack]


@dataclass
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature: log-odds, |z|
    gumbel_lambda: float = 1.0
    gumbel_k: float = 0.1
    bias: float = -1.1
    slope: float = 0.3
    known: dict[str, float | None] = field(default_factory=dict, repr=False, compare=False)  # words met: log-odds of their best feature

    def scan(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        words = tokens(text)
        known = self.known
        if len(known) > HELD_WORDS:
            known.clear()
        for w in set(words):
            if w in known:
                continue
            found = max((x for f in features(w) if (x := self.weights.get(f))), key=lambda x: x[1], default=None)
            known[w] = found[0] if found else None
        scored = [(i, s + DRIFT) for i, s in enumerate(map(known.__getitem__, words)) if s is not None]
        return len(words), segments(scored, DRIFT)

    def p_value(self, score: float, n: int) -> float:
        """Chance that a clean text of n tokens has a segment of this score."""
        return -math.expm1(-self.gumbel_k * max(n, 1) * math.exp(-min(self.gumbel_lambda * score, 700)))

    def evidence(self, text: str | None) -> tuple[float, list[tuple[float, int, int, float]]]:
        """-ln p of the best segment and a tenth of it for each further significant one; the significant segments with their p."""
        n, found = self.scan(text)
        scored = sorted(((*x, max(self.p_value(x[0], n), CLEAN_FLOOR)) for x in found), key=lambda x: (x[3], x[1]))
        if not scored:
            return 0.0, []
        passages = [x for x in scored if x[3] <= SIGNIFICANT]
        return -math.log(scored[0][3]) + 0.1 * sum(-math.log(x[3]) for x in passages[1:]), sorted(passages, key=lambda x: x[1])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-700, min(700, self.bias + self.slope * self.evidence(text)[0])))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a feature; (null, toxic, n): documents."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["feature", "toxic", "n"])
        seen.clear()
        return b

    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen.update((f, y) for f in {f for w in set(tokens(text)) for f in features(w)})
            seen[None, y] += 1
            if len(seen) > COUNTED:
                yield out()
    if seen:
        yield out()


def _fit_logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> tuple[float, float]:
    """bias, slope by Newton's method, label 1 weighing ``share`` of all."""
    w = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    a = np.stack([np.ones_like(x), x], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge * b
        hess = (a * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def log_odds(counted: DataFrame, a: str, b: str) -> dict[str, tuple[float, float]]:
    """Log-odds with the informative Dirichlet prior (features' overall rates, worth PRIOR documents), by feature, with |z|.

    counted: feature, and how many toxic and clean documents have it (columns ``a`` and ``b``; a null feature: of all).
    z is the root of the likelihood ratio statistic, which holds up where one count is zero; log-odds
    shrink by 1 - (Z_NONE / z)^2, as those of little evidence are the largest of many by chance.
    """
    n = counted.where("feature is null").select(a, b).first()
    if n is None or min(n) == 0:
        return {}
    total, all_of, rows = F.col(a) + F.col(b), float(sum(n)), counted.where("feature is not null")
    base = PRIOR * total / all_of
    odds = lambda x, size: F.log((F.col(x) + base) / (size + PRIOR - F.col(x) - base))
    part = lambda x, size: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) * all_of / (total * float(size)))).otherwise(0.0)
    z = F.sqrt(2 * F.greatest(F.lit(0.0), part(a, n[0]) + part(b, n[1])))
    weight = (odds(a, n[0]) - odds(b, n[1])) * (1 - F.pow(Z_NONE / F.col("z"), 2))
    got = rows.where(total > 0).withColumn("z", z).where(F.col("z") >= Z_MIN).select("feature", "z", weight.alias("weight")).toArrow()  # the significant ones of at most 4 * SAMPLE documents
    return dict(zip(got.column("feature").to_pylist(), zip(got.column("weight").to_pylist(), got.column("z").to_pylist(), strict=True), strict=True))


def _rest(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, part): distinct texts of at most SAMPLE labelled rows for each label and part; part 0: log-odds, 1: calibration."""
    rest = _rest("doc_id")
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").withColumn("rest", rest).where("rest <> 0").withColumn("part", (F.col("rest") == 4).cast("int"))
    mine = mine.groupBy("doc_id", "part").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    chosen = None
    for part in (0, 1):
        for toxic in (0, 1):
            some = mine.where((F.col("part") == part) & (F.col("toxic") == toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
            chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "toxic", "part")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic", "part").where("text is not null")
    rows = rows.groupBy("text").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"), F.min("part").alias("part"))
    return rows.where("toxic = other").select("text", "toxic", "part")


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    spark = documents.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(training_rows(documents, labels).repartition(parts), "toxicity")  # long and short texts are dealt out evenly
    hit = lambda y, p: F.sum(F.when((F.col("toxic") == y) & (F.col("part") <= p), F.col("n")).otherwise(0))
    one = "feature string, toxic int, n long"
    counted = rows.where("part = 0").select("text", "toxic").mapInArrow(_count, one).withColumn("part", F.lit(0)).unionByName(rows.where("part = 1").select("text", "toxic").mapInArrow(_count, one).withColumn("part", F.lit(1)))
    counted = stored(counted.groupBy("feature").agg(hit(1, 0).alias("a0"), hit(0, 0).alias("b0"), hit(1, 1).alias("a1"), hit(0, 1).alias("b1")), "features")  # of at most 4 * SAMPLE documents

    release(spark)
    model = Model(log_odds(counted, "a0", "b0"))
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scans = [m.scan(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in scans], pa.int64()), pa.array([max((s for s, _, _ in x), default=0.0) for _, x in scans], pa.float64()), b.column(1)], names=["n", "best", "toxic"])

    null = [(r["n"], r["best"]) for r in rows.where("part = 1").select("text", "toxic").mapInArrow(measure, "n long, best double, toxic int").where("toxic = 0").collect()]
    if len(null) >= 20:
        # a Gumbel law: best = (ln(K n) + g) / lambda; moments of best after taking out ln(n) at the slope that fits
        best = np.array([b for _, b in null])
        size = np.log(np.maximum([k for k, _ in null], 1))
        spread = max(float(best.std()), 0.35)  # clean texts without any evidence would give no spread at all
        model.gumbel_lambda = math.pi / (spread * math.sqrt(6))
        model.gumbel_k = math.exp(float(np.mean(model.gumbel_lambda * best - size)) - 0.5772)
    held.unpersist()
    held = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([m.evidence(t)[0] for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "toxic"])

    xy = rows.where("part = 1").select("text", "toxic").mapInArrow(weigh, "x double, toxic int").collect()
    held.unpersist()
    y = np.array([r["toxic"] for r in xy], float)
    if len(xy) and 0 < y.sum() < len(y):
        share = labels.where("doc_id is not null and toxic in (0, 1)").where(_rest("doc_id") != 0).agg(F.avg("toxic")).first()[0]
        model.bias, model.slope = _fit_logistic(np.array([r["x"] for r in xy]), y, share)
    # The law and the calibration were fitted with weights that had not seen part 1; these have seen both.
    model.weights, model.known = log_odds(counted, "a1", "b1"), {}
    release(spark)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages (text and position of every significant segment, in words) of every whole text."""
    spark = documents.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                scores, passages = [], []
                for text in b.column(1).to_pylist():
                    x, found = m.evidence(text)
                    scores.append(float(1 / (1 + math.exp(-max(-700, min(700, m.bias + m.slope * x))))))
                    passages.append([{"start": s, "end": e, "score": v, "p": p} for v, s, e, p in found])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)], names=["doc_id", "score", "predicted", "passages"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start:int,end:int,score:double,p:double>>")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` less the rows predicted toxic."""
    held = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    at = documents.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                yield b.filter(pa.array([m.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)
