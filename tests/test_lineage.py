"""Every candidate ends somewhere; repairs come to an end."""

from pyspark.sql import functions as F

from colloquy.operators import lineage as L
from colloquy.operators import semantics as N

CANDIDATE = "meeting_id int, candidate_id string, fact_id string, origin_id string, revision_id string, kind string, statement string, evidence_ids array<string>"
ACTIONS = "array<struct<action_id:string,actor:string,predicate:string,object:string,recipient:string,parallel:boolean,temporal_state:string,commitment_state:string,evidence_ids:array<string>>>"
RECORD = f"meeting_id int, record_id string, origin_id string, kind string, statement string, evidence_ids array<string>, actions {ACTIONS}, assignees array<string>, assignment_status string, verification_status string"
FACT = f"meeting_id int, fact_id string, type string, topic string, statement string, certainty string, start double, evidence_ids array<string>, evidence array<struct<id:string,speaker:string,text:string>>, owner_refs array<string>, speaker_refs array<string>, entities array<string>, verification_status string, raw {N.RAW}"
DONE = [("A01", "A", "x", None, None, False, "planned", "unknown", ["U1"])]


def fact(i, text, speaker="A"):
    return (1, f"F{i}", "action", None, f"Работа {i}", None, 0.0, [f"U{i}"], [(f"U{i}", speaker, text)], [], [], [], None, None)


def record(i, actions=(), owners=(), kind="action", status="supported", origin=None, statement=None, evidence=None):
    return (1, f"F{i}", origin or f"O{i}", kind, statement or f"Работа {i}", evidence or [f"U{i}"], list(actions), list(owners), "unknown", status)


def candidate(i, kind="action", origin=None, revision=None, statement=None, evidence=None, fact_id=None):
    return (1, f"C{i}", fact_id or f"F{i}", origin or f"O{i}", revision, kind, statement or f"Работа {i}", evidence or [f"U{i}"])


def test_every_candidate_ends_in_one_state(spark):
    candidates = [
        candidate(1, origin="O1:A2"), candidate(2), candidate(3), candidate(4), candidate(5, kind="decision"), candidate(6, kind="proposal", origin="none6", statement="другое"), candidate(7, kind="resource", origin="none7", statement="файл"),
        candidate(8, revision="r8"), candidate(9, origin="O9:A1"), candidate(10, kind="observation", origin="none10", statement="ничего"), candidate(11, kind="decision", origin="new11", statement="Работа 5", evidence=["U5"]),
    ]
    records = [record(1, DONE, ["A"]), record(2), record(3), record(5, kind="decision"), record(8), record(9)]
    facts = [fact(2, "я подготовлю отчёт"), fact(3, "просто слова")]
    p = L.preflight(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(records, RECORD), spark.createDataFrame(facts, FACT), spark.createDataFrame([("O9:A4", None), (None, "r8")], "origin_id string, revision_id string"))
    got = {x["candidate_id"]: (x["status"], x["reason"]) for x in p.dispositions.collect()}
    assert got == {
        "C1": ("canonical_task", "task_state:lineage_root"), "C2": ("canonical_task", "task_state:exact_origin"), "C3": ("requires_verification", "quarantine_claim:exact_origin"), "C4": ("requires_verification", "quarantine_claim:exact_origin"),
        "C5": ("canonical_claim", "claim_state:exact_origin"), "C6": ("proposal_unconfirmed", "no_acceptance_or_assignee"), "C7": ("not_a_work_result", "resource_without_commitment"), "C8": ("rejected", "explicit_review_denial"), "C9": ("rejected", "explicit_review_denial"),
        "C10": ("requires_verification", "synthesized_quarantine"), "C11": ("canonical_claim", "claim_state:semantic_rekey"),
    }
    assert {x["root"]: x["status"] for x in p.repairs.collect()} == {"O2": "repaired_task", "O3": "quarantined", "O4": "quarantined"}
    out = {x["record_id"]: x for x in p.records.collect()}
    assert out["F2"]["assignees"] == ["A"] and out["F2"]["actions"][-1]["predicate"] == "подготовлю"
    assert {k for k, x in out.items() if x["verification_status"] == "insufficient_evidence"} == {"F3", "F4", "F10"} and len(out) == 8


def test_a_repair_that_undoes_a_task_needs_a_second_round(spark):
    # C1 came to record F2 by its text; repairing F2 from its fact leaves it without an owner, so that root O2 loses its task
    candidates = [candidate(1, statement="Работа 2", evidence=["U2"]), candidate(2)]
    records = [record(2, DONE, ["A"])]
    seen = []

    def tasks(df):
        seen.append(1)
        return L.tasks(df)

    facts = [(1, "F2", "action", None, "Работа 2", None, 0.0, ["U2"], [("U2", "A", "я подготовлю отчёт"), ("U3", "B", "я отправлю письмо")], [], [], [], None, None)]
    p = L.preflight(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(records, RECORD), spark.createDataFrame(facts, FACT), spark.createDataFrame([], "origin_id string, revision_id string"), tasks)
    assert {x["candidate_id"]: x["status"] for x in p.dispositions.collect()} == {"C1": "requires_verification", "C2": "requires_verification"}
    assert {x["root"]: x["status"] for x in p.repairs.collect()} == {"O1": "quarantined", "O2": "quarantined"}
    assert len(seen) == 6  # two rounds of two, the round that finds nothing open, and the end
    assert p.records.where(F.col("verification_status") == "insufficient_evidence").count() == 2


def test_no_candidates(spark):
    p = L.preflight(spark.createDataFrame([], CANDIDATE), spark.createDataFrame([record(1)], RECORD), spark.createDataFrame([fact(1, "x")], FACT), spark.createDataFrame([], "origin_id string, revision_id string"))
    assert p.dispositions.count() == p.repairs.count() == 0 and p.records.count() == 1
