"""Versioned state: deltas, upserts, reconciliation, lifecycles, decisions, patches and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# fixed values: which state category a kind of claim belongs to, and those whose items stay open
CATEGORY = {
    "decision": "active_decisions", "action": "active_tasks", "definition": "definitions", "system_rule": "system_rules", "trading_rule": "trading_rules",
    "hypothesis": "open_experiments", "experimental_result": "known_results", "question": "open_questions", "blocker": "blockers",
}
OPEN = ("open_questions", "blockers", "active_tasks")
SUPERSEDING = ("corrects", "supersedes", "rejects")
ROWS_PER_TASK = 500_000  # of sides that are compared whole


def category(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv]), kind)


def delta(previous: DataFrame, current: DataFrame, keys: Sequence[str], state: str, open_rows: Column | None = None) -> DataFrame:
    """(keys, status, previous_state, state): NEW, RESOLVED, CHANGED, STILL_OPEN or CONFIRMED.

    ``open_rows``: a condition on the keys for rows that stay open (gone: RESOLVED, same: STILL_OPEN).
    """
    p = previous.select(*keys, F.struct(F.col(state).alias("s")).alias("_p"))
    c = current.select(*keys, F.struct(F.col(state).alias("s")).alias("_c"))
    is_open = F.coalesce(open_rows, F.lit(False)) if open_rows is not None else F.lit(False)
    status = (
        F.when(F.col("_p").isNull(), "NEW").when(F.col("_c").isNull(), F.when(is_open, "RESOLVED").otherwise("CHANGED"))
        .when(~F.col("_p.s").eqNullSafe(F.col("_c.s")), "CHANGED").when(is_open, "STILL_OPEN").otherwise("CONFIRMED")
    )
    return p.join(c, list(keys), "full").select(*keys, status.alias("status"), F.col("_p.s").alias("previous_state"), F.col("_c.s").alias("state"))


def upsert(previous: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``previous`` whose keys don't change, and of ``changes`` the last of each key by ``order``."""
    latest = changes
    if order:
        latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*changes.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return previous.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest)


def update_project_state(previous: DataFrame, claims: DataFrame) -> DataFrame:
    """Upserts active claims into (category, statement).  claims: kind, lifecycle, question_status, statement, claim_id, meeting_id."""
    c = claims.withColumn("category", category(F.col("kind"))).where("category is not null and lifecycle = 'active'")
    c = c.where(~((F.col("category") == "open_questions") & (F.coalesce("question_status", F.lit("")) == "answered")))
    return upsert(previous, c.select(*previous.columns), ["category", "statement"], ["claim_id"])


def latest_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def normalize_relations(relations: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges of a known kind between two different known claims with evidence; evidence without repeats."""
    ids = claims.select("claim_id").distinct()
    r = relations.where(F.col("type").isin(*S.RELATION_KINDS) & (F.col("source_claim_id") != F.col("target_claim_id"))).withColumn("evidence_ids", F.array_distinct("evidence_ids")).where(F.size("evidence_ids") > 0)
    return r.join(ids.withColumnRenamed("claim_id", "source_claim_id"), "source_claim_id", "left_semi").join(ids.withColumnRenamed("claim_id", "target_claim_id"), "target_claim_id", "left_semi").select(*relations.columns)


def reconcile_lifecycle(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Claims' lifecycle after correcting edges in order of relation_id: the target superseded or rejected, the source active; later edges override."""
    known = claims.select("claim_id").distinct()
    edges = relations.where(F.col("type").isin(*SUPERSEDING))
    for end in ("source_claim_id", "target_claim_id"):
        edges = edges.join(known.withColumnRenamed("claim_id", end), end, "left_semi")
    effects = edges.select("relation_id", F.explode(F.array(
        F.struct(F.col("target_claim_id").alias("claim_id"), F.lit(0).alias("k"), F.when(F.col("type") == "rejects", "rejected").otherwise("superseded").alias("l"), F.lit(True).alias("basis")),
        F.struct(F.col("source_claim_id").alias("claim_id"), F.lit(1).alias("k"), F.lit("active").alias("l"), F.lit(False).alias("basis")),
    )).alias("e")).select("relation_id", "e.*")
    last = effects.groupBy("claim_id").agg(F.max_by("l", F.struct("relation_id", "k")).alias("_l"), F.array_sort(F.collect_list(F.when(F.col("basis"), F.col("relation_id")))).alias("lifecycle_basis"))
    own = F.coalesce("lifecycle", F.lit("active")) if "lifecycle" in claims.columns else F.lit("active")
    return claims.join(last, "claim_id", "left").withColumn("lifecycle", F.coalesce("_l", own)).withColumn("lifecycle_basis", F.coalesce("lifecycle_basis", F.array().cast("array<string>"))).drop("_l")


def conflict_sets(relations: DataFrame) -> DataFrame:
    """Contradicting pairs, resolved if a correcting edge points at a member."""
    pairs = relations.where("type = 'contradicts'").select("relation_id", F.array_sort(F.array("source_claim_id", "target_claim_id")).alias("members"))
    fixed = relations.where(F.col("type").isin(*SUPERSEDING)).select(F.col("target_claim_id").alias("_t")).distinct()
    hit = pairs.select("relation_id", F.explode("members").alias("_t")).join(fixed, "_t", "left_semi").select("relation_id").distinct().withColumn("_hit", F.lit(True))
    return pairs.join(hit, "relation_id", "left").select("relation_id", "members", F.coalesce("_hit", F.lit(False)).alias("resolved"))


def reduce_decisions(candidates: DataFrame, transitions: DataFrame) -> DataFrame:
    """Status per proposition: superseded, else the last accept or reject, else decided, deferred, candidate.

    transitions: proposition_id, type, at, event_id, actor.
    """
    last = transitions.groupBy("proposition_id").agg(
        F.bool_or(F.col("type").isin("supersedes", "corrects")).alias("_over"),
        F.max_by("type", F.when(F.col("type").isin("accepts", "rejects"), F.struct("at", "event_id"))).alias("_verdict"),
        F.bool_or(F.col("type") == "decides").alias("_decided"), F.bool_or(F.col("type") == "defers").alias("_deferred"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "accepts", F.col("actor")))).alias("accepted_by"),
    )
    verdict = F.when(F.col("_verdict") == "accepts", "accepted").when(F.col("_verdict") == "rejects", "rejected")
    status = F.when(F.col("_over"), "superseded").when(verdict.isNotNull(), verdict).when(F.col("_decided"), "accepted").when(F.col("_deferred"), "deferred").otherwise("candidate")
    return candidates.join(last, "proposition_id", "left").withColumn("status", status).drop("_over", "_verdict", "_decided", "_deferred")


def source_commitments(turns: DataFrame, keys: Sequence[str], text: str = "text", speaker: str = "speaker") -> DataFrame:
    """The one speaker per key who promises in the first person; keys with several or none are left out."""
    promised = turns.where(F.col(text).rlike(S.COMMITMENT))
    return promised.groupBy(*keys).agg(F.count_distinct(speaker).alias("_n"), F.min(speaker).alias("owner")).where("_n = 1").drop("_n")


def cross_episode_allowed(units: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Per unit (unit_id, claim_ids, relation_ids): whether its claims lie in one episode or are all touched by its relations."""
    spread = units.select("unit_id", F.explode("claim_ids").alias("claim_id"))
    episodes = spread.join(claims.select("claim_id", "episode_id"), "claim_id").groupBy("unit_id").agg(F.count_distinct("episode_id").alias("_e"))
    ends = units.select("unit_id", F.explode("relation_ids").alias("relation_id")).join(relations, "relation_id").select("unit_id", F.explode(F.array("source_claim_id", "target_claim_id")).alias("claim_id"))
    touched = ends.groupBy("unit_id").agg(F.collect_set("claim_id").alias("_touched"))
    out = units.join(episodes, "unit_id", "left").join(touched, "unit_id", "left")
    inside = F.size(F.array_except("claim_ids", F.coalesce("_touched", F.array().cast("array<string>")))) == 0
    return out.select("unit_id", ((F.coalesce("_e", F.lit(0)) <= 1) | inside).alias("allowed"))


def set_difference(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (with repeats) only in one of both: column side."""
    names = previous.columns
    signed = previous.withColumn("_n", F.lit(-1)).union(current.withColumn("_n", F.lit(1)))
    # one grouping for both sides, and as many tasks as rows ask for: most rows differ from each other, so that each takes memory
    parts = max(int(previous.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(previous.count() + current.count()) // ROWS_PER_TASK))
    left = signed.repartition(parts, *[F.col(c) for c in names]).groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    # repeats by thousands first, so that no array is longer
    most = F.lit(1000).cast("long")
    some = left.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.abs("_n") - 1) / most))))
    each = some.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(most, F.abs("_n") - F.col("_k") * most))))
    return each.select(*names, F.when(F.col("_n") < 0, "removed").otherwise("added").alias("side"))


def assign_surfaces(surfaces: DataFrame, packets: DataFrame) -> DataFrame:
    """The packet that shares most source ids with each surface (first on ties), else one by turn."""
    # packets: packet_pos from 0, source_ids
    n = packets.count()
    by_id = packets.select("packet_pos", F.explode(F.array_distinct("source_ids")).alias("_s"))
    spread = surfaces.select("surface_pos", F.explode_outer(F.array_distinct("source_ids")).alias("_s"))
    hits = spread.join(by_id, "_s").groupBy("surface_pos", "packet_pos").agg(F.count("*").alias("_n"))
    best = hits.groupBy("surface_pos").agg(F.max_by("packet_pos", F.struct("_n", (-F.col("packet_pos")).alias("_t"))).alias("_p"))
    return surfaces.join(best, "surface_pos", "left").withColumn("packet_pos", F.coalesce("_p", F.pmod("surface_pos", F.lit(max(1, n))))).drop("_p")


def union_inventories(units: DataFrame, core: DataFrame) -> DataFrame:
    """Units of all packets under ids with their packet's name, and how often each core row is accounted for (status: ok, missing, repeated)."""
    named = units.withColumn("unit_id", F.concat_ws(":", "packet_id", "unit_id"))
    seen = named.select(F.explode("source_ids").alias("source_id"), "packet_id").distinct()
    n = core.join(seen, ["packet_id", "source_id"], "left").groupBy("source_id").agg(F.count(seen["packet_id"]).alias("n"))
    return n.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").otherwise("repeated"))


def versioned_upsert(graph: DataFrame, meeting: DataFrame, meeting_id: str, revision: int) -> DataFrame:
    """A project graph with one meeting's claims replaced.  Columns: meeting_id, claim_id, family, statement, revision, change.

    change: NEW for a family not seen before, CHANGED if its last statement differs, CONFIRMS if not.
    """
    rest = graph.where(F.col("meeting_id") != meeting_id)
    last = rest.groupBy("family").agg(F.max_by("statement", F.struct("revision", "claim_id")).alias("_last"))
    new = meeting.join(last, "family", "left").withColumn("change", F.when(F.col("_last").isNull(), "NEW").when(F.col("_last") != F.col("statement"), "CHANGED").otherwise("CONFIRMS"))
    return rest.unionByName(new.select(F.lit(meeting_id).alias("meeting_id"), "claim_id", "family", "statement", F.lit(revision).alias("revision"), "change"))


def reconcile_tasks(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(task_pos, action_id, outcome) of regenerated tasks: exact fingerprint, else a source anchor that is unique on both sides, else new.

    fresh: task_pos, fingerprint, anchor; stored: action_id, fingerprint, anchor, edited.
    """
    exact = fresh.join(stored.groupBy("fingerprint").agg(F.min("action_id").alias("action_id")), "fingerprint").select("task_pos", "action_id", F.lit("same").alias("outcome"))
    left_f, left_s = fresh.join(exact, "task_pos", "left_anti"), stored.join(exact.select("action_id"), "action_id", "left_anti")
    one = lambda df, c: df.groupBy("anchor").agg(F.min(c).alias(c), F.count("*").alias(f"_n_{c}"))
    anchored = one(left_f, "task_pos").join(one(left_s, "action_id"), "anchor").where("_n_task_pos = 1 and _n_action_id = 1").select("task_pos", "action_id", F.lit("anchored").alias("outcome"))
    new = left_f.join(anchored, "task_pos", "left_anti").select("task_pos", F.lit(None).cast(stored.schema["action_id"].dataType).alias("action_id"), F.lit("new").alias("outcome"))
    return exact.unionByName(anchored).unionByName(new)


def task_conflicts(stored: DataFrame, plan: DataFrame) -> DataFrame:
    """Edited stored tasks that a plan doesn't place."""
    return stored.where("edited").join(plan.where("action_id is not null").select("action_id"), "action_id", "left_anti")


def overlay(generated: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Generated rows with users' fields put over them."""
    p = patches.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_edited"))
    out = generated.join(p, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in generated.columns], F.coalesce("_edited", F.lit(False)).alias("edited"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir; only in local mode one beside the warehouse's tables will do."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint")
    return df.checkpoint(eager=True)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): connected components of (a, b), by least labels spread along edges and label by label."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u is not null and v is not null").distinct()
    both = cut(both)  # every round reads them
    label = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    label = cut(label)
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("_m"))
        step = label.join(near, F.col("node") == F.col("u")).select("node", F.least("root", "_m").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        new = cut(step.join(jump, "root").select("node", F.col("_r").alias("root")))
        if not new.join(label.withColumnRenamed("root", "_o"), "node").where("root <> _o").limit(1).count():
            return new
        label = new
    raise RuntimeError("components did not settle")
