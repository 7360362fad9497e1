"""Ranked search against a score of every document for every item."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import lexical


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    rows = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in docs]
    full = [r for r in rows if r[2]]
    n_docs, n_terms = len(full), sum(r[2] for r in full)
    df = Counter(t for _, c, _ in full for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, c, n in full:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in q.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(r, n):
    words = [f"w{i}" for i in range(60)] + ["Éte", "日本", "naïve", "x9"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i * 2, r.choice([" ", "-", "\n"]).join(r.choices(words, weights, k=r.choice([0, 1, 3, 20, 60])))) for i in range(n)]
    docs += [(9000 + i, "w1 W2 w3 w3") for i in range(n // 3)]  # copies: equal scores
    docs += [(None, "w1 w2 w3 w3"), (None, None), (7, "w50 w51 W50"), (7, "w50"), (1, ""), (2, None), (3, "--- !!"), (4, "w5 " * 30_000)]
    items = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 4, 30])))) for i in range(25)]
    items += [(30, "unknown terms only"), (31, None), (32, ""), (33, "w50 w50"), (33, "w51"), (33, "w51"), (None, "w40 w3"), (34, "w1 w2"), (35, "W50-w51_w52 " * 3)]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"SLICE": 7, "PAIRS": 40, "EXPANDED": 50, "WANTED": 3}])
@pytest.mark.parametrize("k", [1, 20])
def test_search_against_brute_force(spark, sizes, k, monkeypatch):
    for name, n in sizes.items():
        monkeypatch.setattr(lexical, name, n)
    docs, items = corpus(random.Random(k), 150)
    extra = {c: F.lit("x") for c in ("n", "terms", "term", "q", "rank", "score", "item", "weight")}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({k: v for k, v in extra.items() if k != "item"}).withColumn("doc_id", F.lit("x"))
    got = sorted(map(tuple, lexical.search(d, i, k).collect()), key=str)
    assert got == brute(docs, items, k)


def test_pruned_terms_cannot_reach_the_threshold(spark):
    docs = [(i, "the cat " * 3 + ("rare" if i < 30 else "")) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    asked = lexical.item_terms(spark.createDataFrame([(1, "the rare cat")], "item_id long, text string"))
    held = lexical.index(d, asked)
    n = held.agg(F.sum("n")).first()[0]
    left = {x["term"]: x["essential"] for x in lexical.seeded(asked, lexical.term_gains(held, 200, n, 20), 200).collect()}
    assert left.pop("rare") and not any(left.values())


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d, i).count() == 0
    assert lexical.search(i.withColumnRenamed("item_id", "doc_id"), i.limit(0)).count() == 0
