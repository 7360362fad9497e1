"""The n-gram model against one of plain dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import kneser

END, BEGIN = "</s>", "<s>"


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + [END]


class Brute:
    def __init__(self, texts, order):
        self.order, rows = order, [tokens(t) for t in texts]
        self.raw = Counter(w for r in rows for w in r)
        grams = {k: Counter() for k in range(1, order + 1)}
        for r in rows:
            s = [BEGIN, *r]
            for k in range(2, order + 1):
                grams[k].update(tuple(s[i - k + 1 : i + 1]) for i in range(k - 1, len(s)))
        for k in range(order - 1, 0, -1):
            follows = Counter(g[1:] for g in grams[k + 1])
            grams[k] = {g: grams[k][g] if k > 1 and g[0] == BEGIN else follows[g] for g in set(follows) | (set(grams[k]) if k > 1 else set())}
        self.grams, self.d, self.after = grams, {}, {}
        for k, g in grams.items():
            t = [sum(c == x for c in g.values()) for x in (1, 2, 3, 4)]
            y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0
            self.d[k] = [0.0]
            for x in (1, 2, 3):
                d = x - (x + 1) * y * t[x] / t[x - 1] if y and t[x - 1] else 0
                self.d[k].append(d if 0 < d <= x else x / 2)
            self.after[k] = defaultdict(list)
            for x, c in g.items():
                self.after[k][x[:-1]].append(c)

    def p(self, history, w):
        k = len(history) + 1
        shorter = self.p(history[1:], w) if history else 1 / (len(self.raw) + 1)
        counts = self.after[k].get(history, [])
        if not counts:
            return shorter
        c = self.grams[k].get((*history, w), 0)
        return (c - self.d[k][min(c, 3)] + sum(self.d[k][min(x, 3)] for x in counts) * shorter) / sum(counts)

    def score(self, text):
        s = [BEGIN, *tokens(text)]
        return sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i]), s[i])) for i in range(1, len(s)))

    def base(self, text):
        n, v = sum(self.raw.values()), len(self.raw)
        return sum(math.log10((self.raw[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text))


def corpus(r):
    words = [f"w{i}" for i in range(40)] + ["É", "é", "A", "ß"]
    weights = [1 / (1 + i) for i in range(len(words))]
    texts = [r.choice([" ", "\n", " \t "]).join(r.choices(words, weights, k=r.choice([0, 1, 2, 15, 50]))) for _ in range(120)]
    return texts + ["hot hot hot W1"] * 60 + [None, "", "  ", "x y \x1c z", "long " * 5000, "a b c a b c"]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(spark, order, small, monkeypatch):
    if small:
        for name, n in (("CHUNK", 100), ("WORD_BYTES", 300), ("GRAM_BYTES", 500), ("IDS", 16)):
            monkeypatch.setattr(kneser, name, n)
    texts = corpus(random.Random(order))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2"), (3, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "shard", "kind", "block", "score", "_row", "n_tokens")}).repartition(3)
    taught = df.where("doc_id % 5 <> 1")
    brute = Brute([t for i, t in rows if i is not None and i % 5 != 1], order)
    model = kneser.train(taught, order)
    assert model.tokens == sum(brute.raw.values()) and model.words == len(brute.raw)
    got = sorted((tuple(x) for x in kneser.score(df, model).collect()), key=str)
    want = sorted([(i, len(tokens(t)), sum(w in brute.raw for w in tokens(t)), model.tokens, brute.base(t), brute.score(t)) for i, t in rows], key=str)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    for a, b in zip(got, want, strict=True):
        assert a[4:6] == pytest.approx(b[4:6], rel=1e-9)
        assert a[6] == pytest.approx(10 ** (-b[5] / b[1]), rel=1e-9)


def test_probabilities_after_a_history_sum_to_one(spark):
    r = random.Random(1)
    texts = [" ".join(r.choices("abcdefg", k=8)) for _ in range(50)]
    model = kneser.train(spark.createDataFrame([(t,) for t in texts], "text string"), 3)
    rows = spark.createDataFrame([(i, f"a b {w}") for i, w in enumerate("abcdefg")] + [(100, "a b"), (101, "a b unseen")], "doc_id long, text string")
    read = kneser.Reader(model)
    total = 0.0
    for c in kneser.chunks(iter(rows.select("doc_id", F.col("text").cast("binary")).toArrow().to_batches())):
        seq, place = kneser.begun(c, read.word_ids(c.words)[0], model.begin)
        total += read.probabilities(seq, place)[place == 3].sum()
    assert total == pytest.approx(1.0)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:6] for x in kneser.score(df, kneser.train(df.limit(0))).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert kneser.score(df.limit(0), kneser.train(df)).count() == 0


def test_exact_keys_and_files(tmp_path):
    x = np.arange(1 << 16, dtype=np.uint64)
    assert len(np.unique(kneser.joined(2, x % 256, x // 256))) == len(x)
    kneser._write(f"{tmp_path}/a/0.arrow", {"key": x, "count": kneser._least(x % 3)})
    kneser._write(f"{tmp_path}/a/0.arrow", {"key": x, "count": kneser._least(x % 3)})  # a task that runs again
    held = kneser.Files().read(f"{tmp_path}/a/0.arrow")
    assert (held["key"] == x).all() and held["count"].dtype == np.uint8
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["0.arrow"]
