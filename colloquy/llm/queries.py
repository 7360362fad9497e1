"""The queries of the training-data operators, one for each, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, codes, counts, decontaminate, jaccard, kneser, lexical, maintext, pieces, ring, secrets, toxicity
from .common import spread, table

PIECE_MODEL = "piece_bpe_32k.model"
BPE_RANKS = "byte_bpe_50k.tiktoken"


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return pieces.digests(pieces.encode(docs, public_tokenizers.path(PIECE_MODEL), decode=True))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(spread(table(spark, sf_dir, "documents")), width=5, percent=80)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(spread(table(spark, sf_dir, "pages")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(table(spark, sf_dir, "documents"), shards=40)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts every document's word counts, then revises them to those of the byte-level BPE; totals by source, lang and version."""
    docs = spread(table(spark, sf_dir, "documents"))
    words = counts.count_words(docs)
    bpe = counts.count_tokens(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, "byte_bpe_50k")
    store = counts.Rollup(spark)
    store.apply("words", counts.inserts(words))
    store.apply("words", counts.inserts(words))  # a replay, which changes nothing
    store.apply("bpe", counts.revisions(words, bpe))
    return store.totals()


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(spread(table(spark, sf_dir, "documents")))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = kneser.score(docs, kneser.train(docs.where(~held), order=2))
    return scored.withColumn("held_out", F.coalesce(held, F.lit(False)))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compress(table(spark, sf_dir, "embeddings"), scale=4096.0, parts=8, entries=16, rounds=6)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_sentencepiece, op3_ngram_jaccard, op4_main_text, op5_decontamination, op6_chat_format, op7_sharding, op8_token_counts, op9_toxicity, op10_secrets, op11_lm_score, op12_lexical_search, op13_vector_codes, pipeline)}

ORACLES = {
    "op1_nearest_neighbours": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10
""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON r.node = e.x AND r.root < e.y),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(c.root, w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
""",
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
    "op13_vector_codes": codes.oracle_sql(),
    "op6_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS t,
    replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), chr(10), '\' || chr(10)) AS r FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('<turn>') + length(r) + 1 + length(t) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
""",
}
