"""Semantic records and timelines against plain Python over lists."""

import random
import re

import pytest

from colloquy.functions import scalars as S
from colloquy.operators import semantics as N
from colloquy.operators import sequence as Q
from colloquy.operators import timeline as T

FACT = f"fact_id string, type string, topic string, statement string, certainty string, start double, evidence_ids array<string>, evidence array<struct<id:string,speaker:string,text:string>>, owner_refs array<string>, speaker_refs array<string>, entities array<string>, verification_status string, raw {N.RAW}"
NAMES = [x.split(":")[0] for x in ("confirmation_evidence_ids", "proposed_by", "conditions", "quantities", "question_status", "answer_evidence_ids", "answer_record_ids", "speech_act", "modality", "content_kind", "predicate", "object", "polarity", "time_expression", "timezone", "requested_slots", "answered_slots", "actions")]


def said(pattern, text):
    flags = re.I if "iuU" in pattern else 0
    return re.search(pattern.replace("(?iuU)", "").replace("(?U)", ""), text, flags) is not None


def fact(i, kind, statement, turns, ids=None, owners=(), **raw):
    ids = [t[0] for t in turns] if ids is None else ids
    return (f"F{i}", kind, None, statement, None, float(i), ids, turns, list(owners), [], [], None, {n: raw.get(n) for n in NAMES})


def brute(row):
    _, kind, _, statement, _, _, ids, turns, refs, _, _, _, raw = row
    people = {s for _, s, _ in turns if s}
    mine = lambda *ps: list(dict.fromkeys(s for _, s, t in turns if s and any(said(p, t or "") for p in ps)))
    working, some, audited = mine(N.PROGRESS, N.PAST), mine(N.PROMISE, N.OWN_TASK, N.PROGRESS, N.PAST), [x for x in refs if x in people]
    work = kind == "action" or said(S.COMMITMENT, statement)
    confirmed = [x for x in raw["confirmation_evidence_ids"] or [] if x in ids]
    owners = []
    if work:
        owners = audited or (some if len(some) == 1 else [])
        confirmed = [x for x in confirmed if any(i == x and s in owners for i, s, _ in turns)]
    elif len(working) == 1:
        owners = audited or working
    status = "not_applicable"
    if work or len(working) == 1:
        status = "confirmed" if owners and confirmed else "unconfirmed" if owners else "unknown"
    amounts = []
    for q in raw["quantities"] or []:
        text = " ".join(next((t or "" for j, _, t in turns if j == x), "") for x in q["evidence_ids"] or [] if x in ids).lower()
        there = [float(x.replace(",", ".")) for x in re.findall(r"(?<!\d)\d+(?:[.,]\d+)?(?!\d)", text)]
        asked = [float(x.replace(",", ".")) for x in re.findall(r"\d+(?:[.,]\d+)?", q["value"] or "")]
        spoken = lambda n: any(re.search(rf"\b{w}(?:часов\w*|дневн\w*|месячн\w*|летн\w*)?\b", text) for w in N.NUMBER_WORDS.get(n, ()))
        if [x for x in q["evidence_ids"] or [] if x in ids] and any(n in there or spoken(n) for n in asked):
            amounts.append(q["value"].strip())
    return owners, confirmed, status, amounts, sorted(x["predicate"].strip() for x in raw["conditions"] or [] if said(N.CONDITION, x["predicate"] or "") and [y for y in x["evidence_ids"] or [] if y in ids])


TEXTS = (
    "Я подготовлю отчёт", "мне нужно проверить 15 серверов", "я сейчас делаю сводку", "я пробовал другой фильтр", "да, согласен", "мы сделаем завтра", "кто отвечает?", "нужно три часа", "12,5 терабайт", "я начал размечать данные", "он начал рисовать", "", None,
)


def test_records_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(150):
        turns = [(f"U{i}.{k}", r.choice(["A", "B", None]), r.choice(TEXTS)) for k in range(r.randrange(4))]
        ids = [t[0] for t in turns] + ["lost"] * r.randrange(2)
        some = lambda: r.sample(ids + ["other"], min(len(ids), 2))  # noqa: B023, E731
        quantities = [{"value": r.choice(["15", "3", "12.5", "7", "", None, "15 штук"]), "evidence_ids": some()} for _ in range(r.randrange(3))]
        conditions = [{"predicate": r.choice(["если готово", "готово", " ", None]), "evidence_ids": some()} for _ in range(r.randrange(3))]
        rows.append(fact(i, r.choice(["action", "proposal", "question", "observation"]), r.choice([t or "" for t in TEXTS]), turns, ids, r.sample(["A", "B", "C"], r.randrange(2)), confirmation_evidence_ids=some(), quantities=quantities, conditions=conditions))
    rows.append((*fact(999, "action", None, [])[:7], None, None, None, None, None, None))
    got = {x["record_id"]: x for x in N.normalize_records(spark.createDataFrame(rows, FACT)).collect()}
    assert len(got) == len(rows)
    for row in rows[:-1]:
        x = got[row[0]]
        assert (x["assignees"], x["confirmation_evidence_ids"], x["assignment_status"], [q["amount"] for q in x["quantities"]], sorted(c["predicate"] for c in x["conditions"])) == brute(row), row


def test_actions_take_clauses_of_their_owner(spark):
    act = {"action_id": "m", "actor": "A", "predicate": "prepare_report", "object": "отчёт", "recipient": "клиент", "temporal_state": "completed", "commitment_state": "accepted_assignment", "parallel": None, "evidence_ids": ["U1"]}
    rows = [
        fact(1, "action", "Отчёт", [("U1", "A", "Я подготовлю отчёт и затем отправлю письмо. Мы сделаем сводку")], actions=[act]),
        fact(2, "action", "Отчёт", [("U1", "A", "я отправлю или передам данные, потом проверю таблицу")]),
        fact(3, "action", "Отчёт", [("U1", "A", "я вчера пробовал фильтр"), ("U2", "B", "проверю")], owners=["A"], actions=[{**act, "object": "лишний предмет", "actor": "C"}]),
        fact(4, "observation", "Вид", [("U1", "A", "просто слова")]),
        fact(5, "action", "Разметка", [("U1", "A", "я сегодня начал раскладывать снимки")]),
    ]
    got = {x["record_id"]: [(a["action_id"], a["actor"], a["predicate"], a["object"], a["recipient"], a["temporal_state"], a["commitment_state"]) for a in x["actions"]] for x in N.normalize_records(spark.createDataFrame(rows, FACT)).collect()}
    assert got["F1"] == [("A01", "A", "подготовлю", "отчёт", None, "planned", "explicit_commitment"), ("A02", "A", "отправлю", "письмо. Мы сделаем сводку", None, "planned", "explicit_commitment")]
    assert got["F2"] == [("A01", "A", "Отчёт", None, None, "planned", "explicit_commitment"), ("A02", "A", "отправлю", "или передам данные", None, "planned", "explicit_commitment"), ("A03", "A", "проверю", "таблицу", None, "planned", "explicit_commitment")]
    assert got["F3"] == [("A01", None, "prepare_report", None, None, "past_attempt", "none")]
    assert got["F4"] == []
    assert got["F5"][-1][2:4] == ("раскладывать", "сегодня снимки")


def test_questions_times_and_terms(spark):
    turn = [("U1", "A", "встретимся после 00:00")]
    rows = [
        fact(1, "question", "По аудио не разобрать имя", turn, question_status="unresolved"), fact(2, "question", "Кто?", turn, answer_evidence_ids=["U1", "x"], answer_record_ids=["F2", "F9", "F9", "z"]), fact(3, "question", "В ответ пояснил срок", turn),
        fact(4, "action", "Встреча", turn, time_expression="00:00"), fact(5, "decision", "Берём Smart Order Flow", [], time_expression="утром"), fact(6, "decision", "Если цена растёт, нужно ждать", []),
    ]
    got = {x["record_id"]: x for x in N.normalize_records(spark.createDataFrame(rows, FACT)).collect()}
    assert [(got[f"F{k}"]["question_status"], got[f"F{k}"]["question_kind"], got[f"F{k}"]["answer_resolution_basis"]) for k in (1, 2, 3)] == [("unresolved", "transcript_verification", None), ("resolved", "discussion", "within_fact_evidence"), ("resolved", "discussion", "within_fact_statement")]
    assert got["F2"]["answer_record_ids"] == ["F9"]
    assert (got["F4"]["time_expression"], got["F4"]["time_status"], got["F4"]["verification_status"]) == ("после 00:00", "ambiguous_clock", "insufficient_evidence")
    assert (got["F5"]["time_status"], got["F5"]["unresolved_terms"], got["F5"]["verification_status"]) == ("source_raw", ["Smart Order Flow"], "insufficient_evidence")
    assert got["F6"]["content_kind"] == "system_rule" and got["F5"]["content_kind"] == "decision"


# ---------------------------------------------------------------- timelines


def spoken(rows, short=1.5, tolerance=0.3):
    rows = [dict(r) for r in rows]
    for k, r in enumerate(rows):
        if r["overlap"] or r["end"] - r["start"] > short or (r["known_speaker"] and r["confidence_level"] != "LOW"):
            continue
        before = next((x for x in reversed(rows[:k]) if x["end"] <= r["start"] + 1e-6), None)
        after = next((x for x in rows[k + 1 :] if x["start"] >= r["end"] - 1e-6), None)
        near = [x for x in (before, after) if x and x["known_speaker"] and not x["overlap"]]
        track = [x for x in near if set(x["primary"]) & set(r["primary"]) or set(x["verifier_mapped"]) & set(r["verifier_mapped"])]
        source = track[0] if track and len({x["speaker_id"] for x in track}) == 1 else near[0] if len(near) == 2 and near[0]["speaker_id"] == near[1]["speaker_id"] else None
        if source:
            r.update(speaker_id=source["speaker_id"], known_speaker=True, confidence=0.74, confidence_level="MEDIUM", decision="short_turn_context")
    out = []
    for r in rows:
        if out and r["speaker_id"] == out[-1][0] and r["overlap"] == out[-1][1] and r["start"] - out[-1][3] <= tolerance:
            out[-1] = (*out[-1][:3], max(out[-1][3], r["end"]), min(out[-1][4], r["confidence"]), out[-1][5])
        else:
            out.append((r["speaker_id"], r["overlap"], r["start"], r["end"], r["confidence"], r["decision"]))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_islands_inherit_from_what_neighbours_became(seed):
    r = random.Random(seed)
    rows, at = [], 0.0
    for _ in range(120):
        at += r.choice([0.0, 0.1, 0.4, 1.0])
        known = r.random() < 0.5
        rows.append({"start": at, "end": at + r.choice([0.0, 0.2, 0.5, 1.4, 3.0]), "speaker_id": r.choice(["profile:1", "profile:2"] if known else ["UNKNOWN_1", "UNKNOWN_2"]), "speaker_name": "n", "known_speaker": known, "confidence": r.choice([0.4, 0.75, 0.95]), "overlap": r.random() < 0.1,
                     "decision": "d", "primary": r.sample("ab", r.randrange(2)), "verifier_mapped": r.sample("cd", r.randrange(2)), "cluster": r.choice("ab")})
        rows[-1]["confidence_level"] = "LOW" if rows[-1]["confidence"] < 0.7 else "MEDIUM"
    rows.sort(key=lambda x: (x["start"], x["end"], x["speaker_id"]))
    f = T.Spoken()
    got = [x for r_ in rows for x in f.row(r_)] + list(f.end())
    assert [(x["speaker_id"], x["overlap"], x["start"], x["end"], x["confidence"], x["decision"]) for x in got] == spoken(rows)
    assert any(x["decision"] == "short_turn_context" for x in got)


def test_decisions(spark):
    one = lambda pos, p, v, end=9.0: ("r", pos, 0.0, end, p, sorted({*p, *v}), p, v, 1.0 if p == v else 0.0, False)
    rows = [one(0, ["a"], ["a"]), one(1, ["a"], ["b"]), one(2, ["a"], ["x"]), one(3, ["x"], ["c"]), one(4, ["a"], ["c"], 1.0), one(5, ["a"], ["c"]), one(6, ["x"], ["y"]), one(7, [], []), one(8, ["a"], ["c"])]
    seg = spark.createDataFrame(rows, "rec string, pos int, start double, end double, clusters array<string>, candidates array<string>, primary array<string>, verifier_mapped array<string>, agreement double, overlap boolean")
    m = spark.createDataFrame([("r", "a", "1", "Ann", 0.9, 0.3, False), ("r", "b", "1", "Ann", 0.8, 0.2, True), ("r", "c", "2", "Bob", 0.7, 0.1, False)], "rec string, cluster string, profile_id string, name string, score double, margin double, session_prototype boolean")
    local = spark.createDataFrame([("r", 8, "7", "Eve", 0.6, 0.1)], "rec string, pos int, profile_id string, name string, score double, margin double")
    got = sorted((x["pos"], x["decision"], x["speaker_id"], x["cluster"], x["bucket"]) for x in T.decided(seg, m, ["rec"], local).collect())
    assert got == [
        (0, "diarizers_agree", "profile:1", "a", "clean_long"), (1, "voice_id_resolved_same_person", "profile:1", "a", "clean_long"), (2, "voice_id_primary", "profile:1", "a", "clean_long"), (3, "voice_id_verifier", "profile:2", "c", "clean_long"),
        (4, "short_turn_verifier", "profile:2", "c", "clean_short"), (5, "primary_low_confidence", "profile:1", "a", "clean_long"), (6, "primary_low_confidence", "UNKNOWN_1", "x", "clean_long"), (8, "redimnet_second_pass", "profile:7", "local:7", "conflict_second_pass"),
    ]


@pytest.mark.parametrize("seed", range(30))
def test_words_take_the_nearest_speaker(seed):
    r = random.Random(seed)
    rows, at = [], 0.0
    for k in range(80):
        at += r.choice([0.0, 0.05, 0.3, 0.6])
        rows.append({"_id": k, "start": at, "end": at + r.choice([0.05, 0.3, 0.5]), "speaker": r.choice(["a", "b", None, None])})
    want = [dict(x) for x in rows]
    for k, x in enumerate(want):
        if x["speaker"] is not None or x["end"] - x["start"] > 0.35:
            continue
        before = next((y for y in reversed(want[:k]) if y["speaker"] is not None), None)
        after = next((y for y in want[k + 1 :] if y["speaker"] is not None), None)
        near = sorted(([(max(0.0, x["start"] - before["end"]), before["speaker"])] if before else []) + ([(max(0.0, after["start"] - x["end"]), after["speaker"])] if after else []))
        if near and near[0][0] <= 0.4 and (len(near) == 1 or near[1][1] == near[0][1] or near[0][0] + 0.12 < near[1][0]):
            x["speaker"] = near[0][1]
    f = Q.Neighbours("speaker")
    got = []
    for k, x in enumerate(rows):
        after = next((y for y in rows[k + 1 :] if y["speaker"] is not None), None)
        got += f.row({**x, "_next": after and {"start": after["start"], "label": after["speaker"]}})
    assert [x["_found"] for x in got] == [x["speaker"] for x in want]
