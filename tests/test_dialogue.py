"""Consensus and dialogue operators against rows worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import consensus as C
from colloquy.operators import dialogue as D


def test_consensus(spark):
    schema = "k int, start double, end double, speaker string"
    p = spark.createDataFrame([(1, 0.0, 5.0, "A"), (1, 5.0, 10.0, "B")], schema)
    v = spark.createDataFrame([(1, 0.1, 5.2, "x"), (1, 5.2, 8.0, "y"), (1, 8.0, 10.0, "x")], schema)
    got = [(r["start"], r["end"], r["decision"], r["clusters"], r["confidence"]) for r in C.consensus(p, v, ["k"]).orderBy("start").collect()]
    assert got == [(0.1, 5.2, "agreement", ["A"], 0.96), (5.2, 8.0, "agreement", ["B"], 0.96), (8.0, 10.0, "disagreement", ["B"], 0.45)]
    m = {(r["left"], r["right"]): r["score"] for r in C.track_matrix(p, v, ["k"], 5.0).collect()}
    assert m["B", "y"] == pytest.approx(0.5 * 2.8 / 5 + 0.25 * 2.8 / 5 + 0.25)


def test_answer_types_and_plurals(spark):
    df = spark.createDataFrame([("entity", ""), ("x", "Когда?"), ("x", "Кто это"), ("zz", "просто")], "s string, q string")
    assert [r[0] for r in df.select(D.answer_type(F.col("s"), F.col("q"))).collect()] == ["entity", "time", "entity", "free_text"]
    t = spark.createDataFrame([("за 2 месяца",), ("21 день",), ("12 часов",), ("15–4 часа",), ("2024 год",), ("нет",)], "t string")
    assert [r[0] for r in t.select(D.duration_scope(F.col("t"))).collect()] == ["2 месяца", "21 день", "12 часов", None, None, None]
    m = spark.createDataFrame([("proposed", None), (None, "tentative"), ("odd", None)], "v string, c string")
    assert [r[0] for r in m.select(D.modality_axis(F.col("v"), F.col("c"))).collect()] == ["possible", "speculative", "certain"]


def test_spans_and_bridges(spark):
    u = spark.createDataFrame([(1, "U1", 0.0, 3.0, "A")], "k int, utterance_id string, start double, end double, speaker string")
    w = spark.createDataFrame([(1, 0, "W1", "Да.", 0.0, 1.0, "A"), (1, 1, "W2", "Ну", 1.0, 2.0, "A"), (1, 2, "W3", "нет", 2.0, 3.0, "B"), (1, 3, "W4", "вот", 3.0, 4.0, "A")], "k int, pos int, word_id string, text string, start double, end double, speaker string")
    assert [(r["text"], r["word_ids"]) for r in D.evidence_spans(u, w, ["k"]).orderBy("span").collect()] == [("Да.", ["W1"]), ("Ну вот", ["W2", "W4"])]
    b = spark.createDataFrame([(1, 0, 0.0, 1.0, "a", "profile:x"), (1, 1, 1.0, 1.5, "b.", None), (1, 2, 1.6, 2.0, "c,", None), (1, 3, 9.0, 9.5, "D", None)], "k int, pos long, start double, end double, text string, speaker string")
    assert [r["speaker"] for r in D.bridge_words(b, ["k"]).orderBy("pos").collect()] == ["profile:x", "profile:x", "profile:x", None]


def test_entities_and_tasks(spark):
    e = spark.createDataFrame([("E1", "Ann", ["Anna"]), ("E2", "Anna", []), ("E3", "Bob", None)], "entity_id string, name string, aliases array<string>")
    m = spark.createDataFrame([("1", "ANNA", ["E2"]), ("2", "anna", []), ("3", "bob!", None), ("4", "zed", None)], "mention_id string, mention string, context_ids array<string>")
    assert {r["mention_id"]: r["entity_id"] for r in D.resolve_mentions(m, D.entity_aliases(e)).collect()} == {"1": "E2", "2": None, "3": "E3", "4": None}
    t = spark.createDataFrame([("m", "t1", 1.0, "подготовить отчет проект", ["A"], "", "", [], "proposed", ["e1"]), ("m", "t2", 2.0, "подготовить отчет проект завтра", ["A"], "", "", [], "accepted", ["e2"]), ("m", "t3", 3.0, "другое дело", ["B"], "", "", ["t2"], "proposed", ["e3"]), ("m", "t4", 4.0, "погода", ["A"], "", "", [], "proposed", [])], "m string, task_id string, start double, text string, assignees array<string>, action string, object string, revises array<string>, status string, evidence_ids array<string>")
    got = {r["group_id"]: (r["task_id"], r["source_task_ids"], r["evidence_ids"]) for r in D.consolidate_tasks(t, ["m"]).collect()}
    assert got == {"TK00001": ("t3", ["t1", "t2", "t3"], ["e1", "e2", "e3"]), "TK00002": ("t4", ["t4"], [])}


def test_redaction_and_budget(spark):
    j = spark.createDataFrame([('{"a": {"api_key": "x", "n": 1.5}, "prompt_tokens": 5}',), ("{bad",), (None,)], "j string")
    assert [r[0] for r in j.select(D.redact_json(F.col("j"))).collect()] == ['{"a": {"api_key": "[REDACTED]", "n": 1.5}, "prompt_tokens": 5}', None, None]
    b = spark.createDataFrame([("j", "x" * 100), ("j", "y" * 200)], "job string, body string")
    caps = [r["max_tokens"] for r in D.allocate_outputs(b, "job", 100_000, 1, 0, 1e-6, 2e-6, 0.0, 10_000_000, 1_000_000).orderBy("body").collect()]
    assert caps == [(100_000 - 120 - 240) // 3 // 2] * 2
    assert [r["max_tokens"] for r in D.allocate_outputs(b, "job", 100, 1, 0, 1e-6, 2e-6, 0.0, 10, 1000).collect()] == [None, None]


def test_centroid(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])] * 4 + [(1, [0.0, 1.0])] + [(2, [3.0, 4.0])], "k int, v array<double>")
    got = {r["k"]: r["centroid"] for r in D.robust_centroid(v, ["k"], "v").collect()}
    assert got[1] == pytest.approx([1.0, 0.0]) and got[2] == pytest.approx([0.6, 0.8])


def test_utterance_words(spark):
    u = spark.createDataFrame([(1, 0, 0.0, 1.0, "A", ""), (1, 1, 1.0, 3.0, "A", "x"), (1, 2, 3.0, 4.0, "B", "y")], "k int, pos int, start double, end double, speaker string, text string")
    w = spark.createDataFrame([(1, 0, 1.0, 1.5, "A", ["w1", "w2"]), (1, 1, 1.5, 3.5, "A", ["w2", "w3"])], "k int, pos int, start double, end double, speaker string, source_word_ids array<string>")
    assert {r["utterance_id"]: r["source_word_ids"] for r in D.utterance_words(u, w, ["k"]).collect()} == {"U00002": ["w1", "w2", "w3"], "U00003": []}


def test_phrases_between_words_of_one_speaker(spark):
    rows = [(1, 0, 0, 0.0, 1.0, "profile:x"), (1, 1, 1, 1.2, 1.5, None), (1, 2, 1, 1.5, 2.0, None), (1, 3, 2, 2.2, 3.0, "profile:x"), (1, 4, 3, 3.1, 3.5, None), (1, 5, 4, 3.6, 4.0, "profile:y")]
    b = spark.createDataFrame(rows, "k int, pos int, phrase int, start double, end double, speaker string")
    assert [r["speaker"] for r in D.bridge_phrases(b, ["k"]).orderBy("pos").collect()] == ["profile:x"] * 4 + [None, "profile:y"]


def test_redaction_limits(spark):
    import json

    deep = {"a": 1}
    for _ in range(12):
        deep = {"d": deep}
    rows = [json.dumps(x) for x in ({"text": "x" * 12_001, "list": list(range(1_002)), "Api_Key_2": [1], "n": 1.123456789012}, deep)]
    got = [json.loads(r[0]) for r in spark.createDataFrame([(x,) for x in rows], "j string").select(D.redact_json(F.col("j"))).collect()]
    assert got[0]["text"] == "x" * 12_000 + "…[TRUNCATED]" and got[0]["list"][-1] == {"truncated_items": 2} and len(got[0]["list"]) == 1_001
    assert got[0]["Api_Key_2"] == "[REDACTED]" and got[0]["n"] == 1.12345679
    x, depth = got[1], 0
    while x != "[MAX_DEPTH]":
        x, depth = x["d"], depth + 1
    assert depth == 9


def test_redaction_masks_every_sensitive_key(spark):
    keys = [*D.SENSITIVE, "refresh_tokens", "api_tokens", "My_Statement_2"]
    rows = [json.dumps({k: "x"}) for k in keys] + [json.dumps({k: 1}) for k in D.TELEMETRY] + [json.dumps({"command": ["--token", "abc", "run", "-p", "--secret-key", {"a": 1}, 5]}), json.dumps({"command": "text"}), json.dumps({"a": ["--token", "abc"]})]
    got = [json.loads(r[0]) for r in spark.createDataFrame([(x,) for x in rows], "j string").coalesce(1).select(D.redact_json(F.col("j"))).collect()]
    assert all(list(x.values()) == ["[REDACTED]"] for x in got[: len(keys)])
    assert all(list(x.values()) == [1] for x in got[len(keys) : len(keys) + len(D.TELEMETRY)])
    assert got[-3:] == [{"command": ["--token", "[REDACTED]", "run", "-p", "--secret-key", "[REDACTED]", "5"]}, {"command": "text"}, {"a": ["--token", "abc"]}]
