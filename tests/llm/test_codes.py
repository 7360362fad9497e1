"""Vector codes against whole-number arithmetic done one vector at a time."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import codes


def brute(rows, parts, entries, rounds, scale=4096):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, _, v in kept]
    dim = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = sorted((r for r in kept if len(r[2]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [[[] for _ in books[p]] for p in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                got[p][near(cut(v, p), p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(x) for c in zip(*x, strict=True)] if x else e for x, e in zip(got[p], books[p], strict=True)] for p in range(parts)]
    out = []
    for i, label, v in kept:
        found = [near(cut(v, p), p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted([(*r, total[r[1]], digest) for r in out], key=str)


@pytest.mark.parametrize("n", [300, 9])
def test_codes_against_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 37)
    r = random.Random(n)
    rows = [(i * 3, r.choice([None, 0, 1]), [r.uniform(-2, 2) for _ in range(16)]) for i in range(n)]
    rows += [(5000 + i, 7, [0.25] * 16) for i in range(n // 3)]  # a third of all are one vector
    rows += [(1, 0, None), (2, 0, [float("nan")] * 16), (4, 0, [float("inf")] * 16), (5, 0, [None] + [0.0] * 15), (7, 1, []), (8, 1, [1.0, 2.0]), (None, None, [0.5] * 16), (10, 1, [0.0] * 16), (10, 1, [0.0] * 16), (10, 2, [-1e-9] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("code", "error", "block", "_whole", "_vec", "_label", "n")}).repartition(5)
    got = sorted(map(tuple, codes.compress(df, parts=4, entries=16).collect()), key=str)
    assert got == brute([(i, label, v) for i, label, v in rows], 4, 16, 6)


def test_floors_of_negative_means():
    books = np.zeros((1, 2, 1), np.int64)
    books[0, 1, 0] = 100
    sums, counts = codes.gathered(None, np.array([[-1, -2, 90]]), books)
    assert sums.tolist() == [[[-3], [90]]] and counts.tolist() == [[2, 1]] and (-3) // 2 == -2
    assert codes.nearest_entries(np.array([[50]]), books)[0].tolist() == [[0]]  # a tie


def test_empty_and_out_of_range(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert codes.compress(df).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and codes.compress(df).count() == 0
    far = spark.createDataFrame([(1, 0, [1e300] * 8)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ArithmeticError):
        codes.compress(far)


def test_decoding_gives_the_entries(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, 0, [r.uniform(-1, 1) for _ in range(8)]) for i in range(40)], "vec_id long, label int, embedding array<double>")
    whole = codes.integers(df)
    books = codes.fit(whole, 8, 4097, parts=4, entries=8)
    for x in codes.decode(codes.compress(df, parts=4, entries=8), books).collect():
        want = [books.entries[p, int(x["code"][2 * p : 2 * p + 2], 16)] / 4096 for p in range(4)]
        assert x["decoded"] == np.concatenate(want).tolist()
