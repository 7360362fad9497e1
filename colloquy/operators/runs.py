"""Queues, leases, stage caches and sealed results as tables: each operator gives the rows that a writer then commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: what of an external job means that a local one waits, is done, or needs a person
PENDING = ("reserved", "submitted", "polling", "active")
CLOSED = ("published", "completed")


def claim(jobs: DataFrame, workers: DataFrame, now: Column, lease_seconds: float, busy: DataFrame | None = None, queued: Sequence[str] = ("queued",)) -> DataFrame:
    """(job_id, worker_id, lease_until): the oldest waiting jobs, one for each worker in order of names.

    jobs: job_id, status, lease_until (seconds); a running job whose lease is over waits again.  ``busy``: job_ids
    that have an active batch elsewhere and are left alone.
    """
    waiting = jobs.where(F.col("status").isin(*queued) | ((F.col("status") == "running") & (F.col("lease_until") <= now)))
    if busy is not None:
        waiting = waiting.join(busy.select("job_id").distinct(), "job_id", "left_anti")
    n = workers.count()
    w = workers.select("worker_id", F.row_number().over(Window.orderBy("worker_id")).alias("_n"))
    oldest = waiting.orderBy("job_id").limit(n).select("job_id", F.row_number().over(Window.orderBy("job_id")).alias("_n"))  # as many rows as workers
    return oldest.join(w, "_n").select("job_id", "worker_id", (now + lease_seconds).alias("lease_until"))


def valid_stages(wanted: DataFrame, cached: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, stage, valid): whether a stage can be taken from the cache: same key, and every artifact of it there with the digest it was stored with.

    wanted: job_id, stage, key, artifacts (names); cached: key, name, digest; files: key, name, digest (of what lies there now).
    """
    need = wanted.select("job_id", "stage", "key", F.explode("artifacts").alias("name"))
    held = cached.select("key", "name", F.col("digest").alias("_c")).join(files.select("key", "name", F.col("digest").alias("_f")), ["key", "name"], "left")
    each = need.join(held, ["key", "name"], "left").groupBy("job_id", "stage").agg(F.bool_and(F.coalesce(F.col("_c") == F.col("_f"), F.lit(False))).alias("_ok"))
    more = cached.join(need.select("key", "name", F.lit(1).alias("_w")).distinct(), ["key", "name"], "left").where("_w is null").select("key").distinct().withColumn("_more", F.lit(True))
    out = wanted.join(each, ["job_id", "stage"], "left").join(more, "key", "left")
    return out.select("job_id", "stage", (F.coalesce("_ok", F.lit(False)) & F.col("_more").isNull()).alias("valid"))


def cache_changes(finished: DataFrame, cached: DataFrame, files: DataFrame) -> DataFrame:
    """(key, name, digest, action): artifacts to store, to leave (kept), or to put in place of corrupt ones (replace)."""
    c = cached.select("key", "name", F.col("digest").alias("_c"))
    f = files.select("key", "name", F.col("digest").alias("_f"))
    j = finished.join(c, ["key", "name"], "left").join(f, ["key", "name"], "left")
    action = F.when(F.col("_c").isNull(), "store").when(F.col("_f").eqNullSafe(F.col("_c")), "kept").otherwise("replace")
    return j.select("key", "name", "digest", action.alias("action"))


def reconcile_queue(jobs: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """(job_id, status): what local jobs have to become after a restart, by the ledger of external jobs; those that stay are left out.

    jobs: job_id, status, attempt_id; ledger: attempt_id, status.  Without a ledger, or without the attempt, nobody
    knows whether something was sent: such a job must not be sent again.
    """
    open_ = jobs.where(F.col("status").isin("running", "pending_batch", "submission_unknown", "credential_required"))
    if ledger is None:
        return open_.where("status = 'running'").select("job_id", F.lit("submission_unknown").alias("status"))
    j = open_.join(ledger.select("attempt_id", F.col("status").alias("_s")), "attempt_id", "left")
    new = F.when(F.col("_s").isNull(), "submission_unknown").when(F.col("_s").isin(*PENDING), "pending_batch").when(F.col("_s").isin(*CLOSED), "done").when(F.col("_s") == "credential_required", "credential_required").otherwise("failed")
    return j.withColumn("_new", new).where(F.col("_new") != F.col("status")).select("job_id", F.col("_new").alias("status"))


def adoptable(requests: DataFrame, sealed: DataFrame) -> DataFrame:
    """(request_id, generation_id): the newest sealed result of the same source and meaning for each request, null without one.

    requests: request_id, source_sha256, semantic_key; sealed: generation_id, source_sha256, semantic_key, sealed_at.
    """
    same = ["source_sha256", "semantic_key"]
    newest = sealed.groupBy(*same).agg(F.max_by("generation_id", F.struct("sealed_at", "generation_id")).alias("generation_id"))
    return requests.join(newest, same, "left").select("request_id", "generation_id")


# fixed values: what ends a batch, and what may have become of an item
TERMINAL = ("completed", "failed", "expired", "cancelled")
OUTCOMES = ("completed", "item_error", "refusal", "refused", "length", "invalid", "missing", "duplicate", "unavailable", "http_error")


ROWS_PER_TASK = 500_000  # outcomes, or rows of which some outcome is made


def tasks(spark: SparkSession, rows: int) -> int:
    """As many tasks as ``rows`` ask for, and as Spark is set to use at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK))


def settle(attempts: DataFrame, items: DataFrame, terminals: DataFrame, outcomes: DataFrame, rows: int | None = None) -> DataFrame:
    """(terminal_id, attempt_id, settled, reason): an attempt is settled once, by the first terminal answer that fits it; the others say why not.

    attempts: attempt_id, status, lease_owner, lease_until, remote_id; items: attempt_id, custom_id; terminals: terminal_id, attempt_id, owner_id,
    remote_status, remote_id, cost, at; outcomes: terminal_id, custom_id, status, billed, prompt_tokens, completion_tokens.  An answer has to come from the
    owner of a lease that still holds, and has one outcome for each item.  Items' costs may exceed the whole by a unit each.
    ``rows``: no fewer than there are outcomes or items, where that is known; else these are counted.  Tasks hold rows of an answer in memory, so that their number goes by it.
    """
    n_tasks = tasks(attempts.sparkSession, max(outcomes.count(), items.count()) if rows is None else rows)
    amounts = ("billed", "prompt_tokens", "completion_tokens")
    poor = ~F.coalesce(F.col("status").isin(*OUTCOMES), F.lit(False))
    for a in amounts:
        poor = poor | F.coalesce(F.col(a) < 0, F.lit(False))
    pairs = items.select("attempt_id", "custom_id").repartition(n_tasks, "attempt_id", "custom_id").distinct()
    known = outcomes.select("terminal_id", "custom_id", "billed", poor.alias("_poor")).repartition(n_tasks, "terminal_id").join(terminals.select("terminal_id", "attempt_id"), "terminal_id")
    given = known.repartition(n_tasks, "attempt_id", "custom_id").join(pairs.withColumn("_asked", F.lit(True)), ["attempt_id", "custom_id"], "left")
    # dealt once for both groupings and for the join with the answers
    each = given.select("terminal_id", "custom_id", "_poor", "billed", "_asked").repartition(n_tasks, "terminal_id").groupBy("terminal_id", "custom_id").agg(F.max("_poor").alias("_poor"), F.sum("billed").alias("_billed"), F.count("*").alias("_rows"), F.max("_asked").alias("_asked"))
    told = each.groupBy("terminal_id").agg(F.max("_poor").alias("_poor"), F.coalesce(F.sum("_billed"), F.lit(0)).alias("_billed"), F.sum("_rows").alias("_rows"), F.count(F.when(F.col("_asked"), F.col("custom_id"))).alias("_met"))
    asked = pairs.repartition(n_tasks, "attempt_id").groupBy("attempt_id").agg(F.count("custom_id").alias("_items"))
    own = attempts.select("attempt_id", F.col("status").alias("_status"), "lease_owner", "lease_until", F.col("remote_id").alias("_remote"))
    j = terminals.join(told, "terminal_id", "left").repartition(n_tasks, "attempt_id").join(own, "attempt_id", "left").join(asked, "attempt_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    fits = (F.col("_status") == "polling") & (F.col("lease_owner") == F.col("owner_id")) & (F.col("lease_until") >= F.col("at")) & (F.col("_remote") == F.col("remote_id")) & (n("_rows") == n("_met")) & (n("_met") == n("_items"))
    reason = (
        F.when(~F.coalesce(F.col("remote_status").isin(*TERMINAL), F.lit(False)), "not_terminal").when(F.col("cost") < 0, "invalid_cost").when(F.coalesce("_poor", F.lit(False)), "invalid_item_outcome")
        .when(F.col("cost").isNotNull() & (n("_billed") > F.col("cost") + n("_rows")), "cost_below_items").when(~F.coalesce(fits, F.lit(False)), "lease_or_items_changed")
    )
    j = j.withColumn("_why", reason)
    fit = F.when(F.col("_why").isNull(), F.struct("at", "terminal_id"))
    out = j.withColumn("_first", F.min(fit).over(Window.partitionBy("attempt_id"))["terminal_id"])  # the answers are made once, in the order of the joins before
    mine = F.col("_why").isNull() & F.col("_first").eqNullSafe(F.col("terminal_id"))
    return out.select("terminal_id", "attempt_id", mine.alias("settled"), F.when(~mine, F.coalesce("_why", F.lit("lease_or_items_changed"))).alias("reason"))
