"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``:

- toxicity: documents predicted toxic go;
- ngram_jaccard: of each group of near copies the document of smallest doc_id stays;
- decontamination: documents that hold a benchmark passage go;
- secrets: found secrets are replaced by a mark of their kind in ``text`` (n_chars follows);
- sentencepiece: ids' and decoded texts' digests of every document.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, jaccard, pieces, secrets, toxicity
from colloquy.llm.common import release, stored, table

PIECE_MODEL = "piece_bpe_32k.model"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return jaccard.keep_one(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return pieces.digests(pieces.encode(docs, public_tokenizers.path(PIECE_MODEL), decode=True))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("sentencepiece", encoded),
]

#: SQL can't express the learned scores, the whole-word digests or the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
