"""Where early candidates of a meeting end: a task, a claim, a rejection, or the verification channel; none is lost.

candidates: meeting_id, candidate_id, fact_id, origin_id, revision_id, kind, statement, evidence_ids.
records: meeting_id, record_id, origin_id, kind, statement, evidence_ids, actions, assignees, assignment_status, verification_status.
facts: as for semantic records (meeting_id, fact_id, evidence and the rest); denials: origin_id, revision_id.

Origins of split actions (``:A1`` and so on) share a root.  Work without a task is repaired once from its own facts, what a model said
left out; work that its source can't support goes to verification.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import facts as X
from . import semantics as N
from . import state as G

WORK = ("action", "follow_up")
DOUBTFUL = ("verification_unavailable", "insufficient_evidence", "contradicted")
REPAIRED = ("actions", "assignees", "assignment_status")
RECORD = ("meeting_id", "record_id", "origin_id", "kind", "statement", "evidence_ids", *REPAIRED, "verification_status")
RULES = {"origin": "exact_origin", "lineage": "lineage_root", "text": "semantic_rekey"}


@dataclass
class Preflight:
    records: DataFrame
    repairs: DataFrame  # meeting_id, root, status, rounds
    dispositions: DataFrame  # meeting_id, candidate_id, status, reason, claim_ids


def root(origin: Column) -> Column:
    return F.regexp_replace(F.coalesce(origin, F.lit("")), r":A\d+$", "")


def tasks(records: DataFrame) -> DataFrame:
    """(meeting_id, root) of records that are work with an owner and an action, and are borne out."""
    fine = F.col("kind").isin(*WORK) & (F.size("actions") > 0) & (F.size("assignees") > 0) & (F.coalesce("verification_status", F.lit("supported")) == "supported")
    return records.where(fine).select("meeting_id", root(F.col("origin_id")).alias("root")).where("root <> ''").distinct()


def matched(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """(meeting_id, candidate_id, record_id, rule): the records each candidate came to, by origin, root or equal text with shared evidence."""
    scope = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat_ws("\u0001", F.col("meeting_id").cast("string"), c))
    within = F.transform("evidence_ids", lambda e: F.concat_ws("\u0001", F.col("meeting_id").cast("string"), e)).alias("evidence_ids")
    side = lambda df, name: df.select(F.struct("meeting_id", name).alias("id"), scope(F.col("origin_id")).alias("origin_id"), scope(root(F.col("origin_id"))).alias("lineage_id"), F.when(S.squeezed("statement") != "", F.col("statement")).alias("statement"), within)
    found = X.match_claims(side(candidates, "candidate_id").withColumnRenamed("id", "candidate_id").where("statement is not null or origin_id is not null"), side(records, "record_id").withColumnRenamed("id", "claim_id"))
    return found.select("candidate_id.*", F.col("claim_id.record_id").alias("record_id"), F.element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col("rule")).alias("rule")).distinct()


def _put(records: DataFrame, fresh: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``records`` with ``columns`` of those rows that ``fresh`` has."""
    new = fresh.select("meeting_id", "record_id", F.struct(*columns).alias("_new"))
    j = records.join(new, ["meeting_id", "record_id"], "left")
    return j.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in RECORD])


def _synthetic(lost: DataFrame, records: DataFrame) -> DataFrame:
    """Records for candidates that have none, for verification only; their id is that of the fact, if it is free."""
    used = records.select("meeting_id", F.col("record_id").alias("fact_id"), F.lit(True).alias("_used"))
    made = S.stable_id("FQ", S.canonical_json({"c": "candidate_id", "o": "origin_id", "r": "revision_id"}))
    free = lost.join(used.distinct(), ["meeting_id", "fact_id"], "left").withColumn("record_id", F.when(F.col("_used").isNull() & (F.coalesce("fact_id", F.lit("")) != ""), F.col("fact_id")).otherwise(made))
    kinds = dict(records.dtypes)
    empty = {"actions": F.array().cast(kinds["actions"]), "assignees": F.array().cast(kinds["assignees"]), "assignment_status": F.lit("unknown"), "verification_status": F.lit("insufficient_evidence"), "kind": F.coalesce("kind", F.lit("observation"))}
    # candidates of one fact are one record
    return free.select(*[empty[c].alias(c) if c in empty else F.col(c) for c in RECORD]).dropDuplicates(["meeting_id", "record_id"])


def preflight(candidates: DataFrame, records: DataFrame, facts: DataFrame, denials: DataFrame, tasks_of: Callable[[DataFrame], DataFrame] = tasks) -> Preflight:
    """Repairs records until every root of work is a task, was repaired, or is rejected; then says where each candidate is.

    A round repairs all roots that are open and were not repaired before; a repair may undo the task of another root,
    which is open in the next round.  As no root is repaired twice, there are at most as many rounds as roots.
    """
    no = G.cut(denials.select(root(F.col("origin_id")).alias("root"), "revision_id").distinct())
    c = candidates.withColumn("root", root(F.col("origin_id")))
    rejected = c.join(no.where("root <> ''").select("root").distinct(), "root", "left_semi").select("meeting_id", "candidate_id")
    rejected = rejected.unionByName(c.join(no.where("revision_id is not null").select("revision_id").distinct(), "revision_id", "left_semi").select("meeting_id", "candidate_id")).distinct()
    c = G.cut(c.join(rejected.withColumn("rejected", F.lit(True)), ["meeting_id", "candidate_id"], "left").withColumn("rejected", F.coalesce("rejected", F.lit(False))))
    work = c.where(~F.col("rejected") & F.col("kind").isin(*WORK) & (F.col("root") != ""))
    plain = facts.withColumn("raw", F.lit(None).cast(N.RAW))
    again = G.cut(N.normalize_records(plain).where(F.size("actions") > 0).select("meeting_id", "record_id", *REPAIRED))
    now = G.cut(records.select(*RECORD))
    tried: DataFrame | None = None
    rounds = 0
    while True:
        open_ = work.join(tasks_of(now), ["meeting_id", "root"], "left_anti")
        if tried is not None:
            open_ = open_.join(tried, ["meeting_id", "root"], "left_anti")
        open_ = G.cut(open_)
        if open_.isEmpty():
            break
        rounds += 1
        sources = matched(open_, now).select("meeting_id", "record_id").distinct()
        fresh = again.join(sources, ["meeting_id", "record_id"], "left_semi")
        after = G.cut(_put(now, fresh, REPAIRED))
        roots = open_.select("meeting_id", "root").distinct()
        left = G.cut(open_.join(tasks_of(after), ["meeting_id", "root"], "left_anti"))
        # what is left has no source that supports it
        mine = matched(left, after).join(left.select("meeting_id", "candidate_id", "root"), ["meeting_id", "candidate_id"]).join(after.select("meeting_id", "record_id", root(F.col("origin_id")).alias("_r")), ["meeting_id", "record_id"]).where(F.col("root") == F.col("_r"))
        mine = G.cut(mine.select("meeting_id", "candidate_id", "record_id", "root"))
        doubt = mine.select("meeting_id", "record_id").distinct().withColumn("verification_status", F.lit("insufficient_evidence"))
        held = _put(after, doubt, ("verification_status",))
        bare = left.join(mine.select("meeting_id", "root").distinct(), ["meeting_id", "root"], "left_anti")
        now = G.cut(held.unionByName(_synthetic(bare, after)))
        told = roots.withColumn("rounds", F.lit(rounds))
        tried = G.cut(told.select("meeting_id", "root") if tried is None else tried.unionByName(told.select("meeting_id", "root")))
    done = tasks_of(now).withColumn("_t", F.lit(True))
    hits = matched(c, now).join(now.select("meeting_id", "record_id", "verification_status"), ["meeting_id", "record_id"])
    per = hits.groupBy("meeting_id", "candidate_id").agg(F.array_sort(F.collect_set("record_id")).alias("claim_ids"), F.min("rule").alias("mode"), F.max(F.coalesce(F.col("verification_status").isin(*DOUBTFUL), F.lit(False))).alias("_doubt"))
    j = G.cut(c.join(done, ["meeting_id", "root"], "left").join(per, ["meeting_id", "candidate_id"], "left"))
    some = F.col("mode").isNotNull()
    told = (
        (F.col("rejected"), "rejected", F.lit("explicit_review_denial")), (F.col("_t").isNotNull(), "canonical_task", F.concat(F.lit("task_state:"), F.coalesce("mode", F.lit("origin_root")))), (some & F.col("_doubt"), "requires_verification", F.concat(F.lit("quarantine_claim:"), "mode")),
        (some, "canonical_claim", F.concat(F.lit("claim_state:"), "mode")), (F.col("kind") == "resource", "not_a_work_result", F.lit("resource_without_commitment")), (F.col("kind") == "proposal", "proposal_unconfirmed", F.lit("no_acceptance_or_assignee")),
    )
    end = None
    for holds, status, reason in told:
        pair = F.struct(F.lit(status).alias("status"), reason.alias("reason"))
        end = F.when(holds, pair) if end is None else end.when(holds, pair)
    j = j.withColumn("_e", end)
    late = _synthetic(j.where("_e is null").select(*candidates.columns), now)
    out = j.select("meeting_id", "candidate_id", F.coalesce("_e.status", F.lit("requires_verification")).alias("status"), F.coalesce("_e.reason", F.lit("synthesized_quarantine")).alias("reason"), F.coalesce("claim_ids", F.array().cast("array<string>")).alias("claim_ids"))
    repairs = work.select("meeting_id", "root").distinct().join(tried, ["meeting_id", "root"], "left_semi") if tried is not None else work.limit(0).select("meeting_id", "root")
    repairs = repairs.join(done, ["meeting_id", "root"], "left").select("meeting_id", "root", F.when(F.col("_t"), "repaired_task").otherwise("quarantined").alias("status"))
    return Preflight(now.unionByName(late), repairs, out)
