"""Queries of queues, caches and vocabulary: orders are jobs, customers their outputs, conversations the words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import runs as R
from .operators import vocabulary as V
from .registry import WORDS, query, table, words

JOBS = "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_custkey AS attempt_id, o_orderkey % 100 AS lease_until FROM orders"


def jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_custkey").alias("attempt_id"), (F.col("o_orderkey") % 100).alias("lease_until"))


@query(f"""
WITH w AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation), j AS (SELECT job_id, row_number() OVER (ORDER BY job_id) AS k FROM ({JOBS}) WHERE (status = 'queued' OR status = 'running' AND lease_until <= 50) AND attempt_id % 3 <> 0)
SELECT job_id, n_name AS worker_id, 50 + 21600.0::DOUBLE AS lease_until FROM j JOIN w USING (k)
""")
def claimed_jobs(spark, sf_dir):
    """Nations are the workers; jobs of every third customer have an active batch."""
    j = jobs(spark, sf_dir)
    return R.claim(j, table(spark, sf_dir, "nation").select(F.col("n_name").alias("worker_id")), F.lit(50), 21_600.0, j.where("attempt_id % 3 = 0").select("job_id"))


@query("""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k AS job_id, 'asr' AS stage, k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AS valid FROM p
""")
def valid_stages(spark, sf_dir):
    """Two artifacts a part; of every fifth one is not stored, of every seventh one is corrupt, of every eleventh one more is stored."""
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    each = p.select("k", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("name")).where((F.col("name") != "c") | (k % 11 == 0))
    cached = each.where((F.col("name") != "b") | (k % 5 != 0)).select(k.alias("key"), "name", F.concat("name", k.cast("string")).alias("digest"))
    files = cached.withColumn("digest", F.when((F.col("key") % 7 == 0) & (F.col("name") == "a"), "bad").otherwise(F.col("digest")))
    wanted = p.select(k.alias("job_id"), F.lit("asr").alias("stage"), k.alias("key"), F.array(F.lit("a"), F.lit("b")).alias("artifacts"))
    return R.valid_stages(wanted, cached, files)


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'store' WHEN p_partkey % 7 = 0 THEN 'replace' ELSE 'kept' END AS action FROM part")
def cache_changes(spark, sf_dir):
    """R03."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit("a").alias("name"), F.lit("d").alias("digest"))
    cached = p.where("key % 5 <> 0")
    return R.cache_changes(p, cached, cached.withColumn("digest", F.when(F.col("key") % 7 == 0, "bad").otherwise(F.col("digest")))).select("key", "action")


@query(f"""
WITH l AS (SELECT c_custkey AS attempt_id, (['reserved', 'published', 'credential_required', 'rejected'])[c_custkey % 4 + 1] AS s FROM customer WHERE c_custkey % 6 <> 0)
SELECT job_id, CASE WHEN s IS NULL THEN 'submission_unknown' WHEN s = 'reserved' THEN 'pending_batch' WHEN s = 'published' THEN 'done' WHEN s = 'credential_required' THEN s ELSE 'failed' END AS status FROM ({JOBS}) LEFT JOIN l USING (attempt_id) WHERE status = 'running'
""")
def reconciled_queue(spark, sf_dir):
    """Customers are the ledger; every sixth is unknown to it."""
    c = F.col("c_custkey")
    ledger = table(spark, sf_dir, "customer").where("c_custkey % 6 <> 0").select(c.alias("attempt_id"), F.get(F.array(*map(F.lit, ("reserved", "published", "credential_required", "rejected"))), (c % 4).cast("int")).alias("status"))
    return R.reconcile_queue(jobs(spark, sf_dir), ledger)


@query("""
WITH s AS (SELECT source, lang, arg_max(doc_id, row(n_chars, doc_id)) AS g FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL)
SELECT doc_id, g AS generation_id FROM documents LEFT JOIN s USING (source, lang)
""")
def adopted_results(spark, sf_dir):
    """Documents of even number are sealed; the longest of the same source and language is the newest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_sha256"), F.col("lang").alias("semantic_key"), "n_chars")
    sealed = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("generation_id"), "source_sha256", "semantic_key", F.col("n_chars").alias("sealed_at"))
    return R.adoptable(d.withColumnRenamed("doc_id", "request_id"), sealed).withColumnRenamed("request_id", "doc_id")


# what the vocabulary finds in the tables' invented words
PHRASES = {"de la": "DELA", "de": "DE", "la le la": "LALELA"}
REPLACED = {"les": "LES", "und": "UND"}
CONTEXT = ({"source": "que", "target": "QUE", "required_context": ["éau"]}, {"source": "et", "target": "ET", "required_context": ["la"], "require_asr_uncertainty": True})
EDGES = "'^([^\\p{{L}}\\p{{M}}\\p{{N}}_@]*)(.*?)([^\\p{{L}}\\p{{M}}\\p{{N}}_]*)$'"


@query(f"""
WITH RECURSIVE w AS (SELECT *, regexp_extract(text, {EDGES.format()}, 1) AS a, regexp_extract(text, {EDGES.format()}, 2) AS b, regexp_extract(text, {EDGES.format()}, 3) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM ({WORDS})),
x AS (SELECT *, replace(lower(b), 'ß', 'ss') AS t, string_agg(replace(lower(text), 'ß', 'ss'), ' ') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM w),
y AS (SELECT *, lead(t) OVER o AS t1, lead(t, 2) OVER o AS t2, lead(c) OVER o AS c1, lead(c, 2) OVER o AS c2, lead(pos) OVER o AS p1, lead(pos, 2) OVER o AS p2 FROM x WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
z AS (SELECT *, CASE WHEN t = 'la' AND t1 = 'le' AND t2 = 'la' THEN 3 WHEN t = 'de' AND t1 = 'la' THEN 2 WHEN t = 'de' THEN 1 ELSE 0 END AS k FROM y),
g AS (SELECT conv_id, 1::BIGINT AS n FROM z WHERE n = 1 UNION ALL SELECT z.conv_id, z.n + greatest(1, z.k) FROM g JOIN z ON z.conv_id = g.conv_id AND z.n = g.n),
f AS (SELECT z.*, CASE k WHEN 3 THEN 'LALELA' WHEN 2 THEN 'DELA' WHEN 1 THEN 'DE' ELSE CASE t WHEN 'les' THEN 'LES' WHEN 'und' THEN 'UND' END END AS exact, CASE WHEN k = 0 AND t = 'que' AND contains(near, 'éau') THEN 'QUE' WHEN k = 0 AND t = 'et' AND contains(near, 'la') AND pos % 2 = 0 THEN 'ET' END AS ctx FROM z JOIN g USING (conv_id, n))
SELECT conv_id, pos, CASE k WHEN 3 THEN p2 WHEN 2 THEN p1 ELSE pos END AS last_pos, CASE WHEN coalesce(exact, ctx) IS NOT NULL THEN a || coalesce(exact, ctx) || CASE k WHEN 3 THEN c2 WHEN 2 THEN c1 ELSE c END ELSE text END AS text, CASE WHEN exact IS NOT NULL THEN 'SAFE_EXACT' WHEN ctx IS NOT NULL THEN 'CONTEXT_REQUIRED' END AS policy FROM f
""")
def domain_vocabulary(spark, sf_dir):
    """words of even place were hard to recognise."""
    return V.apply_vocabulary(words(spark, sf_dir), ["conv_id"], PHRASES, REPLACED, CONTEXT, F.col("pos") % 2 == 0)


@query(f"""
WITH w AS (SELECT *, CASE WHEN pos % 3 = 0 THEN NULL WHEN pos % 20 < 10 THEN 'a' ELSE 'b' END AS pr, CASE WHEN pos % 4 = 0 THEN NULL WHEN pos % 30 < 15 THEN 'x' ELSE 'x,y' END AS tr, start + floor(pos / 7) * 0.4 AS s, start + floor(pos / 7) * 0.4 + 0.3 AS e FROM ({WORDS})),
f AS (SELECT *, CASE WHEN lag(pos) OVER o IS NULL OR s - lag(e) OVER o > 2.5 OR right(rtrim(lag(text) OVER o, ' '), 1) IN ('.', '?', '!', '…') THEN 1 ELSE 0 END AS f FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
c AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cl FROM f),
g AS (SELECT *, last_value(pr IGNORE NULLS) OVER b AS p0, last_value(tr IGNORE NULLS) OVER b AS t0, lag(e) OVER o AS e0, row_number() OVER o AS k FROM c WINDOW o AS (PARTITION BY conv_id, cl ORDER BY pos), b AS (PARTITION BY conv_id, cl ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN k = 1 OR (coalesce(pr <> p0, false) OR coalesce(tr <> t0, false)) AND greatest(0.0::DOUBLE, s - e0) >= 0.25 THEN 1 ELSE 0 END AS h FROM g)
SELECT conv_id, pos, (sum(h) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS clause FROM h
""")
def identity_clauses(spark, sf_dir):
    """A pause at every seventh word."""
    pos = F.col("pos")
    w = words(spark, sf_dir)
    at = F.col("start") + F.floor(pos / 7) * 0.4
    tracks = F.when(pos % 4 != 0, F.when(pos % 30 < 15, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"), F.lit("x"))))
    w = w.withColumn("start", at).withColumn("end", F.col("start") + 0.3).withColumn("profile", F.when(pos % 3 != 0, F.when(pos % 20 < 10, "a").otherwise("b"))).withColumn("tracks", tracks)
    return V.identity_clauses(w, ["conv_id"]).select("conv_id", "pos", F.col("clause").cast("bigint").alias("clause"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders), l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(CAST(round(l_quantity) AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
t AS (SELECT k * 2 + x AS id, k, c, s, x FROM o, (VALUES (0), (1)) AS v(x)),
i AS (SELECT t.id, count(n) AS n, coalesce(sum(q), 0) AS b FROM t JOIN l USING (k) WHERE NOT (t.id % 7 = 0 AND n = 1) GROUP BY t.id), a AS (SELECT k, count(*) AS n FROM l GROUP BY k),
r AS (SELECT t.*, CASE WHEN t.id % 11 = 0 THEN 'not_terminal' WHEN t.id % 13 = 0 THEN 'invalid_cost' WHEN t.id % 17 = 0 AND coalesce(i.n, 0) > 0 THEN 'invalid_item_outcome' WHEN t.id % 3 = 0 AND coalesce(b, 0) > 50 + coalesce(i.n, 0) THEN 'cost_below_items'
  WHEN s = 'F' OR c % 5 = 0 OR t.id % 19 = 0 OR coalesce(i.n, 0) <> coalesce(a.n, 0) THEN 'lease_or_items_changed' END AS why FROM t LEFT JOIN i USING (id) LEFT JOIN a USING (k)),
f AS (SELECT k, min(id) AS first FROM r WHERE why IS NULL GROUP BY k)
SELECT id AS terminal_id, r.k AS attempt_id, why IS NULL AND id = first AS settled, CASE WHEN why IS NULL AND id = first THEN NULL ELSE coalesce(why, 'lease_or_items_changed') END AS reason FROM r LEFT JOIN f USING (k)
""")
def settled_attempts(spark, sf_dir):
    """Orders are attempts of their lines, each with two terminal answers; some of every kind don't fit."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    attempts = o.select(key.alias("attempt_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("polling").alias("status"), F.when(F.col("o_custkey") % 5 == 0, "other").otherwise("me").alias("lease_owner"), F.lit(10).alias("lease_until"), key.alias("remote_id"))
    rows = 2 * line.count()
    items = line.repartition(R.tasks(spark, rows), "l_orderkey").groupBy(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("custom_id")).agg(F.max(F.round("l_quantity").cast("bigint")).alias("billed"))
    t = o.select(key.alias("attempt_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x")).withColumn("terminal_id", F.col("attempt_id") * 2 + F.col("x"))
    n = F.col("terminal_id")
    terminals = t.select(
        "terminal_id", "attempt_id", F.lit("me").alias("owner_id"), F.when(n % 11 == 0, "running").otherwise("completed").alias("remote_status"), F.when(n % 19 == 0, -1).otherwise(F.col("attempt_id")).alias("remote_id"),
        F.when(n % 13 == 0, -1).when(n % 3 == 0, 50).alias("cost"), F.col("x").alias("at"),
    )
    outcomes = t.join(items, "attempt_id").where(~((n % 7 == 0) & (F.col("custom_id") == 1))).select("terminal_id", "custom_id", F.when(n % 17 == 0, "odd").otherwise("completed").alias("status"), "billed", F.lit(None).cast("long").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))
    return R.settle(attempts, items, terminals, outcomes, rows)
