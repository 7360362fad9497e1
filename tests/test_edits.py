"""Merges, revisions, admission and meeting state against plain Python."""

import itertools
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from colloquy.operators import edits as E
from colloquy.operators import publication as P
from colloquy.plans import dialogue_state as Y

# ---------------------------------------------------------------- merges


def brute_merge(base, variants):
    """Every pair of different edits is compared, position by position."""
    split = lambda t: E._TOKENS.findall(t)
    tokens, edits = split(base), []
    for v in variants:
        other = split(v)
        edits += [(a, b, tuple(other[c:d])) for tag, a, b, c, d in SequenceMatcher(None, tokens, other, autojunk=False).get_opcodes() if tag != "equal"]
    edits = sorted(set(edits), key=lambda e: e[:2])
    for (a, b, _), (c, d, _) in itertools.combinations(edits, 2):
        inner = lambda p, x, y: x < p < y
        if set(range(a, b)) & set(range(c, d)) or (a == b == c == d) or (a == b and inner(a, c, d)) or (c == d and inner(c, a, b)):
            return None
    for a, b, new in reversed(edits):
        tokens[a:b] = new
    return "".join(tokens)


@pytest.mark.parametrize("seed", range(60))
def test_merge_against_brute_force(seed):
    r = random.Random(seed)
    words = [r.choice("abcdefg") for _ in range(r.randrange(1, 12))]
    variants = []
    for _ in range(r.randrange(4)):
        v = list(words)
        for _ in range(r.randrange(1, 3)):
            k = r.randrange(len(v) + 1)
            v[k : k + r.randrange(2)] = [r.choice("xyz")] * r.randrange(2)
        variants.append(" ".join(v))
    assert E.merged(" ".join(words), variants) == brute_merge(" ".join(words), variants)


def test_merge_of_rows(spark):
    rows = [(1, "a b c d", ["x b c d", "a b c y"]), (2, "a b c", ["x b c", "y b c"]), (3, "a b", []), (4, "a b", None), (5, None, ["new"]), (6, "a b", [None, "a c"]), (7, "a  b\n", ["a  b\n"]), (8, "a b", ["a b c", "a b c"])]
    df = spark.createDataFrame(rows, "i int, b string, v array<string>")
    got = {x["i"]: x["m"] for x in df.select("i", E.merge_texts(F.col("b"), F.col("v")).alias("m")).collect()}
    assert got == {1: "x b c y", 2: None, 3: "a b", 4: "a b", 5: "new", 6: "a c", 7: "a  b\n", 8: "a b c"}


def test_bundles_go_in_whole_or_not_at_all(spark):
    bases = spark.createDataFrame([("s1", "a b c"), ("s2", "d e"), ("s3", "f")], "surface_id string, text string")
    patches = spark.createDataFrame([("b1", "s1", "x b c"), ("b2", "s1", "y b c"), ("b2", "s2", "d z"), ("b3", "s2", "q e"), ("b4", "s9", "?"), ("b5", "s3", "g"), ("b6", "s2", "d e !")], "bundle_id string, surface_id string, text string")
    links = spark.createDataFrame([("b5", "b4"), ("b6", "b0")], "bundle_id string, needs string")
    out, rejected = E.merge_bundles(bases, patches, links)
    assert {x["bundle_id"]: x["reason"] for x in rejected.collect()} == {"b1": E.CONFLICT, "b2": E.CONFLICT, "b4": "unknown_surface", "b5": "dependency_rejected", "b6": "unknown_dependency"}
    assert {x["surface_id"]: (x["text"], x["changed"]) for x in out.collect()} == {"s1": ("a b c", False), "s2": ("q e", True), "s3": ("f", False)}


# ---------------------------------------------------------------- revisions


def test_concurrent_edits(spark):
    r = random.Random(1)
    rows = [(r.randrange(4), i, r.choice([0, 0, 1, 2, 3, None, -1]), {r.choice("ab"): r.choice("xy")} if r.random() < 0.9 else None, r.choice(["ann", " ", None, "n" * 201, "bob"]), r.randrange(6)) for i in range(80)]
    edits = spark.createDataFrame(rows, "key int, edit_id int, expected_revision int, changes map<string,string>, actor string, edited_at int")
    current = spark.createDataFrame([(0, 0, {"a": "x"}), (1, 2, None), (2, 0, {})], "key int, revision int, patch map<string,string>")
    state, want = {0: [0, {"a": "x"}], 1: [2, {}], 2: [0, {}]}, {}
    for key, i, expected, changes, actor, _ in sorted(rows, key=lambda x: (x[5], x[1])):
        if key not in state:
            want[i] = ("unknown", None)
            continue
        s = state[key]
        if expected is None or expected < 0 or not changes or not (actor or "").strip() or len(actor.strip()) > 200:
            what = "invalid"
        elif expected != s[0]:
            what = "revision_conflict"
        elif all(s[1].get(k) == v for k, v in changes.items()):
            what = "unchanged"
        else:
            what, s[0], s[1] = "applied", s[0] + 1, {**s[1], **changes}
        want[i] = (what, s[0])
    out = E.compare_and_swap(current, edits, ["key"])
    assert {x["edit_id"]: (x["outcome"], x["revision"]) for x in out.collect()} == want
    assert {x["key"]: [x["revision"], dict(x["patch"] or {})] for x in E.revised(current, out, ["key"]).collect()} == state
    log = E.history(out, edits, ["key"])
    assert log.groupBy("key", "revision").count().where("count > 1").count() == 0 and log.count() == sum(w[0] == "applied" for w in want.values())


def test_admission_counts_what_was_admitted_before(spark):
    intents = "intent_id long, intent_key string, workflow_id string, stage string, payload_sha256 string, items int, reserve long, created_at int"
    rows = [(1, "k1", "w", "audit", "p1", 8, 10, 1), (2, "k2", "w", "audit", "p2", 8, 10, 2), (3, "k3", "w", "audit", "p3", 4, 10, 3), (4, "k1", "w", "audit", "p1", 8, 10, 4), (5, "k1", "w", "audit", "other", 8, 10, 5), (6, "k6", "v", "audit", "p", 1, 95, 1), (7, "k7", "v", "audit", "p", 1, 10, 2), (8, "k0", "v", "audit", "p0", 2, 5, 3), (9, "k9", "none", "audit", "p", 1, 1, 1), (10, "k2", "w", "audit", "p2", 8, 10, 6)]
    flows = spark.createDataFrame([("w", "active", 100), ("v", "active", 100)], "workflow_id string, status string, planned long")
    tries = spark.createDataFrame([("a0", "k0", "v", "audit", "p0", "done", 1, 2, 5, None)], "attempt_id string, intent_key string, workflow_id string, stage string, payload_sha256 string, status string, posts int, items int, reserved long, billed long")
    got = {x["intent_id"]: (x["decision"], x["attempt_id"], x["reason"]) for x in P.admit_batch(spark.createDataFrame(rows, intents), flows, tries, spark.createDataFrame([(0,)], "spent_microusd long")).collect()}
    assert got == {
        1: ("new", "k1", None), 2: ("blocked", None, "logical_job_item_limit"), 3: ("new", "k3", None), 4: ("pending", "k1", None), 5: ("blocked", None, "intent_identity_changed"), 6: ("new", "k6", None),
        7: ("blocked", None, "logical_job_budget_exceeded"), 8: ("pending", "a0", None), 9: ("blocked", None, "unknown_workflow"), 10: ("blocked", None, "logical_job_item_limit"),
    }


# ---------------------------------------------------------------- meeting state

RECORD = (
    "meeting_id int, record_id string, kind string, statement string, topic string, start double, subject string, predicate string, object string, polarity string, speech_act string, revision_cue boolean, quantities array<struct<value:string,unit:string,entity:string,role:string>>, "
    "attributed_speakers array<string>, risks array<string>, answer_record_ids array<string>, assignment_status string, question_status string"
)


def brute_state(rows, ids):
    out = set()
    rows = sorted(rows, key=lambda r: (r[5], ids[r[0], r[1]]))
    act = lambda r: Y.ACT_OF_SPEECH.get(r[10]) or Y.ACT_OF_KIND.get(r[2]) or r[2]
    words = lambda r: {w for w in " ".join(x for x in (r[6], r[7], r[8], r[3]) if x).lower().split() if len(w) > 2 and w not in Y.IGNORED}
    sign = lambda r: {tuple(x or "" for x in q) for q in r[12] or ()}
    for k, c in enumerate(rows):
        cue = bool(c[11]) or c[10] == "correct"
        scope = [(j, o) for j, o in enumerate(rows[:k]) if o[0] == c[0] and set(o[13] or ()) & set(c[13] or ()) and c[5] - o[5] <= 180 and o[10] not in ("ask", "accept", "reject") and (o[4] == c[4] or sum(x[0] == c[0] for x in rows[j:k]) <= 3)]
        if cue and scope:
            out.add((c[1], "corrects", scope[-1][1][1], "explicit_revision_scope"))
        for o in rows[:k]:
            if o[0] != c[0]:
                continue
            a, b = words(c), words(o)
            if not ((c[6] and c[7] and (c[6], c[7]) == (o[6], o[7])) or len(a & b) / max(1, min(len(a), len(b))) >= 0.55):
                continue
            kind = None
            if c[9] != o[9]:
                kind = "contradicts"
            elif sign(c) != sign(o) and sign(c) and sign(o):
                kind = "supersedes" if cue else "conflicts_with"
            elif act(c) == "decision" and act(o) in ("proposal", "assertion"):
                kind = "accepts"
            elif c[10] == "answer" and act(o) == "question":
                kind = "answers"
            elif "correction" in (c[14] or ()) or c[11]:
                kind = "corrects"
            if kind:
                out.add((c[1], kind, o[1], "same"))
    return out


def test_meeting_state_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "это", "sigma", "kappa"]
    rows = []
    for i in range(120):
        q = [(r.choice("12"), None, None, None)] if r.random() < 0.4 else None
        rows.append((r.choice([1, 1, 1, 2]), f"F{i}", r.choice(["decision", "question", "observation", "proposal"]), " ".join(r.choices(vocabulary, k=r.randrange(6))), r.choice("ab"), float(r.randrange(400)), r.choice(["s", None]), r.choice(["p", "q", None]), None, r.choice(["positive", "negative"]),
                     r.choice(["assert", "answer", "correct", "ask", None]), r.random() < 0.1, q, r.sample("XYZ", r.randrange(3)), r.choice([None, ["correction"]]), None, None, None))
    state = Y.meeting_state(spark.createDataFrame(rows, RECORD))
    ids = {(x["meeting_id"], x["record_id"]): x["event_id"] for x in state.events.collect()}
    name = {v: k[1] for k, v in ids.items()}
    got = {(name[x["source_event"]], x["relation"], name[x["target_event"]], x["basis"] if x["basis"] == "explicit_revision_scope" else "same") for x in state.relations.collect()}
    assert got == brute_state(rows, ids)
    assert state.events.where("lifecycle = 'superseded'").count() == len({t for _, k, t, _ in got if k in ("supersedes", "corrects")})
    assert Y.meeting_state(spark.createDataFrame([], RECORD)).events.count() == 0


def test_long_chains_settle(spark):
    from colloquy.operators import facts as X

    n = 60
    units = spark.createDataFrame([(f"u{k}", ["s" if k else "none"], [f"u{k - 1}"] if k else []) for k in range(n)] + [("fine", ["s"], [])], "unit_id string, source_ids array<string>, depends_on array<string>").coalesce(1)
    kept, gone, _ = X.salvage_inventory(units, spark.createDataFrame([("s",)], "source_id string"))
    assert [x["unit_id"] for x in kept.collect()] == ["fine"] and gone.count() == n


def test_scopes_of_a_task(spark):
    from colloquy.operators import graph as R

    turn = [("U1", "ann", "да, согласен", 5.0), ("U2", "ann", "ну ладно, месяц дальше", 9.0), ("U3", "bob", "да", 9.0)]
    tasks = spark.createDataFrame([(1, "T1", None, "ann", []), (1, "T2", "1 месяц", "ann", turn), (1, "T3", "1 месяц", "bob", None)], "m int, task_id string, scope string, owner string, turns array<struct<id:string,speaker:string,text:string,start:double>>")
    props = spark.createDataFrame([(1, "p1", "за 2 недели", "x"), (1, "p2", "три дня", "x"), (1, "p3", "4 часа", "constraint"), (1, "p4", "5 дней", "x")], "m int, proposition_id string, statement string, content_kind string")
    rel = [(1, f"r{p}{t}", "revises_scope", f"p{p}", f"T{t}", ["e"]) for p in (1, 2, 3, 4) for t in (1, 2, 3)] + [(1, "a", "accepts", "x", "p4", ["e"])]
    relations = spark.createDataFrame(rel, "m int, relation_id string, type string, source_id string, target_id string, evidence_ids array<string>")
    events = spark.createDataFrame([(1, "p1", "propose", 1.0), (1, "p2", "assert", 2.0), (1, "p3", "assert", 3.0), (1, "p4", "propose", 4.0)], "m int, proposition_id string, speech_act string, start double")
    got = {x["task_id"]: (x["current_scope"], x["scope_confidence"], [h["value"] for h in x["scope_history"]], [h["value"] for h in x["proposed_scopes"]], x["relation_ids"]) for x in R.scope_history(tasks, props, relations, events, ["m"]).collect()}
    assert got == {
        "T1": ("5 дней", "accepted", ["2 недели"], ["4 часа"], ["r11", "r41"]), "T2": ("5 дней", "accepted", ["1 месяц"], ["2 недели", "4 часа"], ["r42"]), "T3": ("5 дней", "accepted", ["1 месяц"], ["2 недели", "4 часа"], ["r43"]),
    }


def test_items_are_held_to_their_claims_own_plans(spark):
    fields = ", ".join(f"{c} array<string>" for c in P.PLAN_FIELDS)
    none = {c: None for c in P.PLAN_FIELDS}
    pick = lambda **k: tuple({**none, **k}[c] for c in P.PLAN_FIELDS)
    claims = spark.createDataFrame([("c1", "Ann checks 5 servers @ann", ["e1"], None, *pick()), ("c2", "second", ["e2"], "active", *pick()), ("c3", "third 7", ["e3"], "superseded", *pick(polarity=["negative"])), ("c4", "alone", None, None, *pick())], f"claim_id string, statement string, evidence_ids array<string>, lifecycle string, {fields}")
    plans = spark.createDataFrame([("p1", ["c1"], *pick(allowed_numbers=["9"])), ("p12", ["c1", "c2"], *pick(allowed_numbers=["8"])), ("p3", ["c3"], *pick(polarity=["positive"]))], f"unit_id string, claim_ids array<string>, {fields}")
    rows = [
        ("own plan", "5 and 9 @ann", ["c1"], ["e1"]), ("number of the group plan", "8", ["c1"], []), ("both: plan of two adds nothing", "9", ["c1", "c2"], []), ("both: statement", "5", ["c1", "c2"], ["e1", "e2"]), ("empty", " ", ["c1"], []), ("orphan", "x", ["zz"], []), ("no claims", "x", None, []),
        ("outside", "x", ["c4"], []), ("some unknown", "5", ["c1", "zz"], ["e1"]), ("evidence", "5", ["c1"], ["e2"]), ("stale", "не 7", ["c3"], ["e3"]), ("claim before plan", "7", ["c3"], []),
    ]
    items = spark.createDataFrame([(a, b, c, [], d) for a, b, c, d in rows], "item_id string, text string, claim_ids array<string>, relation_ids array<string>, evidence_ids array<string>")
    got = {x["item_id"]: x["errors"] for x in P.verify_items(items, claims, plans).collect()}
    assert got == {
        "own plan": [], "number of the group plan": ["slot_quantity", "unplanned_number"], "both: plan of two adds nothing": ["slot_quantity", "unplanned_number"], "both: statement": [], "empty": ["empty_public_text"], "orphan": ["orphan_public_item", "unknown_claim"],
        "no claims": ["orphan_public_item"], "outside": ["claim_outside_plan"], "some unknown": ["unknown_claim"], "evidence": ["evidence_outside_closure"], "stale": ["inactive_claim_published"], "claim before plan": ["inactive_claim_published", "negation_not_preserved"],
    }


def test_contracts_of_units_are_what_items_are_held_to(spark):
    claims = spark.createDataFrame([(1, "c1", "Ann checks 5 servers", "2 дня", ["@ann"], None, "positive", None, ["если"], "accepted"), (1, "c2", "7 @bob", None, None, "@bob", "negative", "tentative", None, None)], "m int, claim_id string, statement string, time_scope string, speaker_refs array<string>, assignee string, polarity string, modality string, conditions array<string>, decision_status string")
    chosen = spark.createDataFrame([(1, "minutes", "c1", 1.0, True), (1, "minutes", "c2", 2.0, None), (1, "tasks", "c2", 2.0, False)], "m int, view string, claim_id string, start double, mandatory boolean")
    relations = spark.createDataFrame([(1, "r1", "c2", "c1"), (1, "r2", "c1", "c9")], "m int, relation_id string, source_claim_id string, target_claim_id string")
    units = P.summary_units(chosen, relations, ["m"])
    assert sorted((x["view"], x["unit_id"], x["claim_ids"], x["relation_ids"], x["unresolved_edges"], x["role"]) for x in units.collect()) == [("minutes", "SU0001", ["c1", "c2"], ["r1"], ["r2"], "state_change"), ("tasks", "SU0001", ["c2"], [], ["r1"], "technical_context")]
    got = {x["view"]: x for x in P.sentence_contracts(units, claims, ["m"]).collect()}
    x = got["minutes"]
    assert (x["allowed_numbers"], x["polarity"], x["modality"], x["conditions"], x["time_scope"], x["decision_state"], sorted(x["allowed_people"])) == (["5", "2", "7"], ["positive", "negative"], ["tentative"], ["если"], ["2 дня"], ["accepted"], ["@ann", "@bob"])
    assert got["tasks"]["allowed_numbers"] == ["7"] and got["tasks"]["time_scope"] == []
