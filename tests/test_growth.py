"""Steps that must not grow faster than their rows: what they read, deal out and look at is counted."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest

from colloquy.operators import dialogue as D
from colloquy.operators import edits as E
from colloquy.operators import runs as R
from colloquy.operators import sequence as Q
from colloquy.operators import state as G
from colloquy.operators import vocabulary as V
from colloquy.plans import dialogue_state as Y
from colloquy.sources import formats as Z


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def exchanges(df):
    return sum(x.strip(" +-:").startswith("Exchange") for x in plan(df).splitlines())


def words(spark):
    rows = [(k, i, float(i), i + 0.3, ("a", "b", None, None)[i * 7 % 4] if k < 2 else None, "de la le la les"[i % 5 * 3 :][:2]) for k in range(3) for i in range(40)]
    return spark.createDataFrame(rows, "k long, pos long, start double, end double, speaker string, text string")


def test_vocabulary_deals_words_once(spark):
    assert exchanges(V.apply_vocabulary(words(spark), ["k"], {"de la": "DELA"}, {"le": "LE"}, ({"source": "la", "target": "LA", "required_context": ["le"]},))) == 1


def test_neighbours_deal_words_once_and_look_one_way(spark):
    out = Q.fill_from_neighbours(words(spark), ["k"], "pos", ["pos"], "speaker")
    assert exchanges(out) == 1 and "unboundedfollowing" not in plan(out).lower()
    assert "unboundedfollowing" not in plan(Q.bridge_gaps(words(spark), ["k"], ["pos"], "speaker", 2.0)).lower()


def test_transcripts_are_read_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"source": "s", "utterances": [{"start": 1, "end": 2, "text": "x"}, {"start": 0, "end": 2, "text": "y"}]}')
    (tmp_path / "b.json").write_text('{"source": "s", "utterances": [{"start": 1, "end": 2, "text": "x"}, {"start": 1, "end": 2.5, "text": "y"}]}')
    (tmp_path / "c.json").write_text('{"source": "s", "duration_seconds": 2, "utterances": [{"start": 1, "end": 2.001}]}')
    (tmp_path / "d.json").write_text('{"source": "s", "utterances": []}')
    good, rejects = Z.read_transcripts(spark, str(tmp_path))
    assert plan(good).count("FileScan") == 1 and exchanges(good) == 0
    assert {r["path"][-6:-5]: r["reason"] for r in rejects.collect()} == {"a": "order", "c": "duration", "d": "no utterances"}
    assert [(r["path"][-6:-5], r["utterance_id"], r["end_ms"]) for r in good.orderBy("pos").collect()] == [("b", "U00001", 2000), ("b", "U00002", 2500)]


def test_state_makes_events_once(spark):
    fields = "meeting_id long, record_id string, kind string, statement string, topic string, start double, subject string, predicate string, object string, polarity string, speech_act string, revision_cue boolean"
    more = ", quantities array<struct<value:string,unit:string,entity:string,role:string>>, attributed_speakers array<string>, risks array<string>, answer_record_ids array<string>, assignment_status string, question_status string"
    rows = [(1, f"R{i}", "decision", "one two three", "t", float(i), None, None, None, "positive", "assert", False, [], ["a"], [], [], None, None) for i in range(3)]
    state = Y.meeting_state(spark.createDataFrame(rows, fields + more))
    assert "regexp_extract_all" not in plan(state.relations)
    assert state.events.count() == 3


def test_merges_look_at_what_differs_only(monkeypatch):
    seen = []

    def counted(junk, a, b, autojunk):
        seen.append(len(a) * len(b))
        return SequenceMatcher(junk, a, b, autojunk)

    monkeypatch.setattr(E, "SequenceMatcher", counted)
    text = [f"w{i}" for i in range(3000)]
    assert E.merged(" ".join(text), [" ".join(["first", *text[1:]]), " ".join([*text[:-1], "last", "more"])]) == " ".join(["first", *text[1:-1], "last", "more"])
    assert sum(seen) < 100


@pytest.mark.parametrize("run", [1, 2, 8])
def test_edits_are_those_of_the_whole_texts(monkeypatch, run):
    monkeypatch.setattr(E, "RUN", run)
    r = random.Random(run)
    for _ in range(3000):
        a = [str(r.randrange(r.choice([2, 10, 200]))) for _ in range(r.randrange(60))]
        b = list(a)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(4)] = r.choices(a or ["x"], k=r.randrange(5))
        want = {(i, j, tuple(b[c:d])) for tag, i, j, c, d in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"}
        assert E._edits(a, b) == want


def test_difference_is_one_grouping_in_tasks_of_so_many_rows(spark, monkeypatch):
    r = random.Random(2)
    a, b = ([(r.choice([None, 1, 2, 3]), r.choice("xy")) for _ in range(60)] for _ in range(2))
    a += [(9, "many")] * 2500
    left, right = (spark.createDataFrame(x, "k int, v string") for x in (a, b))
    out = G.set_difference(left, right)
    want = Counter([(*x, "removed") for x in (Counter(a) - Counter(b)).elements()] + [(*x, "added") for x in (Counter(b) - Counter(a)).elements()])
    assert exchanges(out) == 1 and Counter(tuple(x) for x in out.collect()) == want
    monkeypatch.setattr(G, "ROWS_PER_TASK", 10, raising=False)
    assert G.set_difference(left, right).rdd.getNumPartitions() == -(-(len(a) + len(b)) // 10)


def test_components_make_edges_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long").mapInArrow(count, "a long, b long")
    assert {x["root"] for x in G.components(edges).collect()} == {0}
    assert made.value <= 40


def test_attempts_are_settled_in_tasks_of_so_many_rows(spark, monkeypatch):
    attempts = spark.createDataFrame([(k, "polling", "me", 10, k) for k in range(20)], "attempt_id long, status string, lease_owner string, lease_until int, remote_id long")
    items = spark.createDataFrame([(k, i) for k in range(20) for i in range(3)], "attempt_id long, custom_id int")
    rows = [(2 * k + x, k, "me", "completed", k, None, x) for k in range(20) for x in range(2)] + [(99, None, "me", "completed", 1, None, 0), (7, 3, "me", "completed", 3, None, 1)]
    terminals = spark.createDataFrame(rows, "terminal_id long, attempt_id long, owner_id string, remote_status string, remote_id long, cost long, at int")
    told = [(2 * k + x, i) for k in range(20) for x in range(2) for i in range(3) if (k, x, i) not in ((1, 0, 2), (2, 1, 0))] + [(8, 1), (10, None), (98, 0)]
    outcomes = spark.createDataFrame([(t, i, "completed", None, None, 1) for t, i in told], "terminal_id long, custom_id int, status string, billed long, prompt_tokens long, completion_tokens long")
    monkeypatch.setattr(R, "ROWS_PER_TASK", 10, raising=False)
    out = R.settle(attempts, items, terminals, outcomes)
    # 2 lacks an item, 7 came twice, 8 tells one twice, 10 tells one without a name
    assert {r["terminal_id"] for r in out.where("settled").collect()} == {2 * k for k in range(20)} - {2, 8, 10} | {3, 9, 11}
    assert out.count() == 42 and {r["reason"] for r in out.where("not settled").collect()} == {"lease_or_items_changed"}
    assert out.rdd.getNumPartitions() == -(-len(told) // 10)


def centroid(vectors):
    x = np.array(vectors, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(x.T[::-1])]
    near = np.round(x @ x.T, 12)
    x = x[np.argsort(near[int(np.argmax(np.sort(near, axis=1)[:, len(x) // 2]))], kind="stable")[len(x) // 5 :]]
    return x.mean(0) / np.linalg.norm(x.mean(0))


@pytest.mark.parametrize("held", [1, 50, 700, 1 << 24])
def test_centroids_compare_a_group_in_tiles(spark, monkeypatch, held):
    monkeypatch.setattr(D, "SIMILARITIES", held, raising=False)
    r = random.Random(4)
    groups = {k: [[r.gauss(0.3, 1) for _ in range(5)] for _ in range(n)] for k, n in ((1.0, 1), (2.0, 4), (3.0, 5), (None, 23), (math.nan, 40))}
    groups[4.0] = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 9 + [[r.random(), r.random()] for _ in range(20)]
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(3.0, None), (3.0, []), (3.0, [0.0] * 5), (5.0, [0.0]), (6.0, [1.0]), (6.0, [1.0, 2.0])]
    r.shuffle(rows)
    out = D.robust_centroid(spark.createDataFrame(rows, "k double, v array<double>"), ["k"], "v")
    assert "FlatMapGroups" not in plan(out)  # no group is handed whole to one task
    got = {str(x["k"]): x["centroid"] for x in out.collect()}
    assert got.pop("5.0") is None and got.pop("6.0") is None
    assert got == {str(k): pytest.approx(centroid(v)) for k, v in groups.items()}


def test_a_tile_holds_its_own_rows_alone():
    x = np.eye(4)[[0, 1, 1, 2] + [3, 0] * 500]
    tile = D._Tile(len(x))
    tile.add(x[:4], np.array([True] * 4))
    for k in range(4, len(x), 100):
        tile.add(x[k : k + 100], np.zeros(len(x[k : k + 100]), bool))
    assert tile.near.shape == (3, len(x)) and tile.at == len(x)
    assert tile.best() == (0.0, [0.0, 0.0, 1.0, 0.0])
