"""Operators against rows worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import scalars as S
from colloquy.operators import aggregates as A
from colloquy.operators import evaluation as E
from colloquy.operators import intervals as I
from colloquy.operators import matching as M
from colloquy.operators import sequence as Q
from colloquy.operators import state as G
from colloquy.plans import stages
from colloquy.sources import formats


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def test_interval_union_merges_touching_and_drops_empty(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 6), (1, 1, 1)], "k int, start int, end int")
    assert sorted(map(tuple, I.union(df, ["k"]).select("start", "end").collect())) == [(0, 3), (5, 6)]
    assert I.measure(df, ["k"]).first()["measure"] == 4
    twice = I.union(I.union(df, ["k"]), ["k"])
    assert sorted(map(tuple, twice.select("start", "end").collect())) == [(0, 3), (5, 6)]


def test_interval_join_has_each_pair_once(spark):
    import random

    r = random.Random(1)
    a = [(i, s := r.randrange(100), s + r.randrange(30)) for i in range(40)]
    b = [(i, s := r.randrange(100), s + r.randrange(30)) for i in range(40)]
    x, y = (spark.createDataFrame(d, "id int, start int, end int").withColumn("k", F.lit(1)) for d in (a, b))
    got = sorted((r["id"], r["r_id"]) for r in I.interval_join(x, y, ["k"], 7).collect())
    assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)
    assert I.interval_join(x, y, ["k"], 7, how="left").select("id").distinct().count() == 40


def test_diarization_error(spark):
    ref = spark.createDataFrame([(1, 0, 10, "a")], "k int, start int, end int, speaker string")
    hyp = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 8, "b"), (1, 12, 14, "a")], "k int, start int, end int, speaker string")
    r = I.error_rate(ref, hyp, ["k"], "speaker", 5).first()
    assert (r["reference_time"], r["miss"], r["false_alarm"], r["confusion"]) == (10, 2, 2, 3)
    assert r["der"] == pytest.approx(0.7)


def test_risks_and_acts(spark):
    r = one(spark, a=S.semantic_risks(F.lit("Я сделаю это завтра")), b=S.semantic_risks(F.lit("да")), c=S.speech_acts(F.lit("Что это?")), d=S.primary_speech_act(F.lit("договорились")), e=S.primary_speech_act(F.lit("погода"), F.lit("action")), f=S.risk_level(F.array(F.lit("negation"), F.lit("quantity")), F.lit("decision")))
    assert r == {"a": ["commitment", "date_time"], "b": ["agreement"], "c": ["ask"], "d": "decide", "e": "commit", "f": "CRITICAL"}


def test_scalars(spark):
    r = one(
        spark, ts=S.timestamp(F.lit(3661.0005)), srt=S.timestamp(F.lit(1.5), True), ms=S.milliseconds(F.lit(0.0125)), bad=S.milliseconds(F.lit(-1.0)), date=S.meeting_date(F.lit("31.12.2024 x")), nodate=S.meeting_date(F.lit("x")),
        once=S.grounded_offset(F.lit("a bc d"), F.lit("bc")), twice=S.grounded_offset(F.lit("bc bc"), F.lit("bc")), up=S.input_upper(F.lit("абв")), grounded=S.grounded(F.lit("есть 5 шт"), F.lit("5 и 6")), loose=S.grounded(F.lit("7"), F.lit("5")),
        same=S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), none=S.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0))), json=S.canonical_json({"b": F.lit(1), "a": F.lit("x")}), name=S.safe_name(F.lit("a b/c.wav")),
    )
    assert r["ts"] == "01:01:01.000" and r["srt"] == "00:00:01,500" and r["ms"] == 12 and r["bad"] is None
    assert str(r["date"]) == "2024-12-31" and r["nodate"] is None and r["once"] == 2 and r["twice"] is None and r["up"] == 8
    assert r["grounded"] and not r["loose"] and r["same"] == pytest.approx(1) and r["none"] == -1 and r["json"] == '{"a":"x","b":1}' and r["name"] == "a_b_c.wav"


def test_replacements_follow_their_policies(spark):
    rules = [{"source": "foo", "target": "bar", "policy": "SAFE_EXACT"}, {"source": "bar", "target": "qux", "policy": "CONTEXT_REQUIRED", "required_context": ["ctx"]}, {"source": "x", "target": "y", "policy": "NEVER_AUTO"}]
    r = one(spark, a=S.replaced(F.lit("foo x ctx"), rules, F.lit(True)), b=S.replaced(F.lit("foo x"), rules, F.lit(True)))
    assert tuple(r["a"]) == ("qux x ctx", ["foo->bar", "bar->qux"]) and tuple(r["b"]) == ("bar x", ["foo->bar"])


def test_utterances_break_on_speaker_gap_and_sentence(spark):
    w = spark.createDataFrame([(1, 0, "a", "Да", 0.0, 1.0), (1, 1, "a", "нет.", 3.0, 4.0), (1, 2, "a", "Ну", 6.0, 7.0), (1, 3, None, "x", 7.0, 8.0), (1, 4, None, "y", 8.0, 9.0)], "k int, pos int, speaker string, text string, start double, end double").withColumn("flags", F.array().cast("array<string>"))
    got = [(r["utterance_id"], r["text"]) for r in Q.utterances(w, ["k"]).orderBy("session").collect()]
    assert got == [("U00001", "Да нет."), ("U00002", "Ну"), ("U00003", "x y")]


def test_repeated_words_of_chunks_go(spark):
    schema = "k int, text string, start double, end double"
    old = spark.createDataFrame([(1, "Проверим", 21.7, 21.9)], schema)
    new = spark.createDataFrame([(1, "Проверим", 21.72, 21.92), (1, "потом", 22.1, 22.5)], schema).withColumn("chunk_start", F.lit(21.55)).withColumn("previous_end", F.lit(22.0))
    assert [r["text"] for r in Q.without_repeats(old, new, ["k"]).collect()] == ["потом"]


def test_folds(spark):
    words = [(1, k, t, float(s), s + 0.5) for k, (t, s) in enumerate([("a", 0), ("b.", 1), ("c", 1.6), ("d", 5)])]
    df = spark.createDataFrame(words, "k int, pos int, text string, start double, end double")
    assert [r["unit"] for r in Q.fold(df, ["k"], ["pos"], Q.PhraseUnits, "pos int, unit int").orderBy("pos").collect()] == [0, 0, 1, 2]
    chunks = Q.fold(spark.createDataFrame([(1, 0.0, 50.0)], "k int, start double, end double"), ["k"], ["start"], Q.SpeechChunks, "start double, end double").orderBy("start").collect()
    assert [(round(r["start"], 2), round(r["end"], 2)) for r in chunks] == [(0.0, 22.0), (21.55, 43.55), (43.1, 50.0)]
    rows = spark.createDataFrame([(1, k, "x" * 40) for k in range(5)], "k int, pos int, text string")
    got = {(r["packet"], r["pos"], r["role"]) for r in Q.packets(rows, ["k"], 400, 1).collect()}
    assert {(0, 0, "core"), (0, 1, "core"), (0, 2, "context"), (1, 2, "core"), (1, 1, "context"), (2, 4, "core")} <= got
    cap = Q.fold(spark.createDataFrame([(1, k, "word", k * 1.0, k + 0.9) for k in range(20)], "k int, pos int, text string, start double, end double"), ["k"], ["pos"], Q.Captions, "caption int, start double, end double, text string").collect()
    assert all(len(r["text"]) <= 92 and r["end"] - r["start"] <= 8 for r in cap) and sum(len(r["text"].split()) for r in cap) == 20


def test_smoothing_and_bridging(spark):
    w = spark.createDataFrame([(1, 0, k, s, float(k), k + 0.9) for k, s in enumerate(["a", "a", "b", "a", "a"])], "k int, unit int, pos int, speaker string, start double, end double")
    assert [r["speaker"] for r in Q.smooth(w, ["k"], "unit").orderBy("pos").collect()] == ["a"] * 5
    g = spark.createDataFrame([(1, 0, "a", 0.0, 1.0), (1, 1, None, 1.0, 2.0), (1, 2, "a", 2.0, 3.0)], "k int, pos int, speaker string, start double, end double")
    assert [r["speaker"] for r in Q.bridge_gaps(g, ["k"], ["pos"], "speaker", 2.0).orderBy("pos").collect()] == ["a"] * 3


def test_profiles_and_retrieval(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0], [[1.0, 0.0]]), (2, [0.0, 1.0], [])], "profile_id int, prototype array<double>, references array<array<double>>")
    v = spark.createDataFrame([(10, [0.9, 0.1])], "id int, v array<double>")
    r = M.match_profiles(v, p, "id", "v").first()
    assert r["profile_id"] == 1 and r["score"] == pytest.approx(0.9) and r["accepted"]
    claims = spark.createDataFrame([("c1", "p1", "запуск сервера завтра", 1.0), ("c2", "p1", "запуск сервера", 2.0), ("c3", "p2", "погода", 3.0)], "claim_id string, proposition_id string, statement string, start double")
    claims = claims.withColumn("lifecycle", F.lit("active")).withColumn("project_revision", F.lit(0)).withColumn("entity_names", F.array().cast("array<string>")).withColumn("embedding", F.array().cast("array<double>"))
    assert [r["claim_id"] for r in M.retrieve(claims, "запуск сервера").collect()] == ["c2", "c3"]
    m = M.mean_vector(spark.createDataFrame([(1, [3.0, 0.0]), (1, [3.0, 8.0])], "k int, v array<double>"), ["k"], "v").first()["mean"]
    assert m == pytest.approx([0.6, 0.8])


def test_lifecycle_and_relations(spark):
    claims = spark.createDataFrame([("a",), ("b",), ("c",)], "claim_id string")
    rel = spark.createDataFrame([("r1", "corrects", "b", "a", ["e"]), ("r2", "rejects", "a", "b", ["e", "e"]), ("r3", "unknown", "a", "c", ["e"]), ("r4", "supports", "a", "a", ["e"])], "relation_id string, type string, source_claim_id string, target_claim_id string, evidence_ids array<string>")
    assert {r["relation_id"] for r in G.normalize_relations(rel, claims).collect()} == {"r1", "r2"}
    got = {r["claim_id"]: r["lifecycle"] for r in G.reconcile_lifecycle(claims, rel).collect()}
    assert got == {"a": "active", "b": "rejected", "c": "active"}


def test_decisions(spark):
    c = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "proposition_id string")
    t = spark.createDataFrame([("p1", "accepts", 1, "e1", "x"), ("p1", "rejects", 2, "e2", "y"), ("p2", "decides", 1, "e3", None), ("p3", "accepts", 1, "e4", "x"), ("p3", "supersedes", 2, "e5", None)], "proposition_id string, type string, at int, event_id string, actor string")
    assert {r["proposition_id"]: r["status"] for r in G.reduce_decisions(c, t).collect()} == {"p1": "rejected", "p2": "accepted", "p3": "superseded", "p4": "candidate"}


def test_metrics(spark):
    df = spark.createDataFrame([("один два три", "один два")], "r string, h string")
    r = E.text_scores(df, "r", "h").first()
    assert r["wer"] == pytest.approx(1 / 3)
    m = spark.createDataFrame([(0.02, 0.0, 0.995, 0.0)], "decision_false_positive double, question_false_resolution double, public_factual_precision double, importance_weighted_recall_regression double")
    g = E.release_gate(m, E.RELEASE_POLICY).first()
    assert g["failures"] == ["decision_false_positive"] and not g["passed"]
    pairs = spark.createDataFrame([(1, "a", "x", 5.0), (1, "a", "y", 4.0), (1, "b", "x", 4.0)], "k int, left string, right string, score double")
    assert {(r["left"], r["right"]) for r in E.best_assignment(pairs, ["k"]).collect()} == {("a", "y"), ("b", "x")}


def test_tasks_and_batches(spark):
    f = spark.createDataFrame([(0, "f1", "a1"), (1, "fx", "a2"), (2, "fy", "a9")], "task_pos int, fingerprint string, anchor string")
    s = spark.createDataFrame([("t1", "f1", "a1", False), ("t2", "f2", "a2", True), ("t3", "f3", "a3", True)], "action_id string, fingerprint string, anchor string, edited boolean")
    plan = G.reconcile_tasks(f, s)
    assert {(r["task_pos"], r["action_id"], r["outcome"]) for r in plan.collect()} == {(0, "t1", "same"), (1, "t2", "anchored"), (2, None, "new")}
    assert [r["action_id"] for r in G.task_conflicts(s, plan).collect()] == ["t3"]
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = spark.createDataFrame([("a", True), ("b", True), ("b", True), ("d", True)], "id string, ok boolean")
    assert {(r["id"], r["outcome"]) for r in A.batch_outcomes(e, got, "id", F.col("ok")).collect()} == {("a", "ok"), ("b", "duplicate"), ("c", "missing"), ("d", "extra")}


def test_stage_order():
    need = {"a": [], "b": ["a"], "c": ["a", "b"], "d": []}
    assert stages.order(need, "c") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        stages.order({"a": ["b"], "b": ["a"]})


def test_sources(spark, tmp_path):
    good = {"source": "01.02.2025 x", "duration_seconds": 3.0, "speakers": {"S1": "Ann"}, "utterances": [{"start": 0.0, "end": 1.0, "speaker": "S1", "text": " a  b "}, {"start": 1.0, "end": 3.0, "speaker": "S2", "text": "c"}]}
    bad = {"source": "y", "duration_seconds": 1.0, "utterances": [{"start": 2.0, "end": 1.0, "speaker": "S1", "text": "a"}]}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/good.json").write_text(json.dumps(good))
    (tmp_path / "t/bad.json").write_text(json.dumps(bad))
    u, rejects = formats.read_transcripts(spark, str(tmp_path / "t"))
    assert [(r["utterance_id"], r["start_ms"], r["speaker"], r["text"]) for r in u.orderBy("pos").collect()] == [("U00001", 0, "Ann", "a b"), ("U00002", 1000, "S2", "c")]
    assert [r["reason"] for r in rejects.collect()] == ["end before start"]
    seg = spark.createDataFrame([(0.5, 2.0, "A")], "start double, end double, speaker string")
    formats.rttm_lines(seg, "m").write.text(str(tmp_path / "rttm"))
    assert tuple(formats.read_rttm(spark, str(tmp_path / "rttm")).first()) == ("m", 0.5, 2.0, "A")
    (tmp_path / "log.jsonl").write_text('{"event_id": "1", "category": "x"}\n{broken\n')
    events, broken = formats.read_events(spark, str(tmp_path / "log.jsonl"))
    assert events.cache().count() == 1 and broken.cache().count() == 1
    formats.publish(seg, str(tmp_path / "pub"), "g1")
    formats.publish(seg.union(seg), str(tmp_path / "pub"), "g2")
    assert formats.current(spark, str(tmp_path / "pub")).count() == 2


def test_meeting_graph(spark):
    from colloquy.plans import meeting

    none = F.array().cast("array<string>")
    rec = spark.createDataFrame(
        [("m", "r1", "decision", "Предлагаю запуск сервера", "A", 0.0, 2.0, ["U1"]), ("m", "r2", "action", "Сделаю отчет", "B", 10.0, 12.0, ["U3"]), ("m", "r3", "question", "Когда срок?", "A", 400.0, 402.0, ["U4"])],
        "meeting_id string, record_id string, kind string, statement string, speaker string, start double, end double, evidence_ids array<string>",
    ).withColumn("actions", F.when(F.col("record_id") == "r2", F.array(F.lit("отчет"), F.lit("письмо"))).otherwise(none)).withColumn("answers", none).withColumn("corrects", none).withColumn("accepts", none)
    turns = spark.createDataFrame([("m", "U1", "A", "Предлагаю запуск сервера", 0.0, 2.0), ("m", "U2", "B", "Да", 3.0, 4.0), ("m", "U3", "B", "Сделаю отчет", 10.0, 12.0), ("m", "U4", "A", "Когда срок?", 400.0, 402.0)], "meeting_id string, turn_id string, speaker string, text string, start double, end double")
    g = meeting.build(rec, turns)
    assert {r["record_id"] for r in g.records.collect()} == {"r1", "r2.1", "r2.2", "r3", "reply-U2"}
    assert [r["type"] for r in g.relations.collect()] == ["accepts"]
    assert [(r["status"], r["accepted_by"]) for r in g.decisions.collect()] == [("accepted", ["B"])]
    assert len({r["episode"] for r in g.episodes.collect()}) >= 2


def test_replies_calibration_and_budget(spark):
    r = one(
        spark, a=S.weak_backchannel(F.lit("Угу. Есть такой инструмент")), b=S.weak_backchannel(F.lit("Хорошо, договорились")), c=S.accepts(F.lit("да"), F.lit("")), d=S.accepts(F.lit("да?"), F.lit("")), e=S.accepts(F.lit("нет"), F.lit("")),
        f=S.accepts(F.lit("подтверждаю это"), F.lit("")), g=S.isotonic(F.lit(0.5), [(0.4, 0.1), (0.6, 0.7)]), h=S.isotonic(F.lit(0.9), [(0.4, 0.1), (0.6, 0.7)]), i=S.voice_bucket(F.lit(1.0), F.lit(False), F.lit(False), F.lit(False), F.lit(False)),
        j=S.alignment(F.lit("запуск сервера завтра"), F.lit("не запуск сервера")), k=S.speaker_probability({"agreement": F.lit(1.0)}),
    )
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"], r["i"]) == (True, False, True, False, False, True, 0.7, 0.7, "clean_short")
    assert tuple(r["j"]) == (1.0, 1.0, True) and r["k"] == pytest.approx(1 / (1 + 2.718281828459045 ** -0.7))
    claims = spark.createDataFrame([(0.0, 540.0, "t1", "decision", True), (1.0, 60.0, "t2", "action", False)], "start double, end double, thread_id string, kind string, mandatory boolean").withColumn("lifecycle", F.lit(None).cast("string"))
    assert A.adaptive_budget(claims, 0).first()["budget"] == 18 and A.adaptive_budget(claims, 0, view="executive").first()["budget"] == 5


def test_chapters(spark):
    rows = [(1, "a", "decision", "запуск сервера в понедельник утром", "x", 5.0), (1, "b", "question", "запуск сервера в понедельник утром!", "y", 1.0), (1, "c", "problem", "база падает", "x", 2.0), (1, "d", "metric", "совсем другое измерение", "x", 3.0)]
    got = Q.chapters(spark.createDataFrame(rows, "k int, item_id string, type string, statement string, topic string, start double"), ["k"])
    assert {r["item_id"] for r in got.collect()} == {"a", "d"}


def test_assignment_of_any_size(spark):
    import itertools
    import random

    from colloquy.operators import evaluation as E

    r = random.Random(1)
    for n, m in ((5, 5), (4, 6), (6, 3)):
        worth = E.np.array([[r.randrange(50) for _ in range(m)] for _ in range(n)], float)
        best = max(sum(worth[i, j] for i, j in zip(range(n), p, strict=False)) for p in itertools.permutations(range(m), n)) if n <= m else max(sum(worth[i, j] for j, i in enumerate(p)) for p in itertools.permutations(range(n), m))
        assert sum(worth[i, j] for i, j in E._assigned(worth)) == best
    rows = [(1, f"l{i:02d}", f"r{j:02d}", 1.0 + (i == j) * 5 + r.random()) for i in range(15) for j in range(14)]
    got = {(x["left"], x["right"]) for x in E.best_assignment(spark.createDataFrame(rows, "k int, `left` string, `right` string, score double"), ["k"]).collect()}
    assert got == {(f"l{i:02d}", f"r{i:02d}") for i in range(14)}
