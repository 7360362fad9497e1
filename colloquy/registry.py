"""Where queries and their SQL are put together, and frames that several of them share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def re2(pattern: str) -> str:
    """A pattern of Spark's (with the flags i, u and U) as SQL text that DuckDB takes; a word border takes up the character at it."""
    out, inside = [], False
    for part in re.findall(r"\\.|.", pattern.replace("(?iuU)", "(?i)").replace("(?U)", ""), re.S):
        if part in ("\\w", "\\W"):
            part = r"\p{L}\p{M}\p{N}_" if inside else r"[\p{L}\p{M}\p{N}_]" if part == "\\w" else r"[^\p{L}\p{M}\p{N}_]"
        elif part == "\\b":
            part = r"(?:^|$|[^\p{L}\p{M}\p{N}_])"
        inside = (inside or part == "[") and part != "]"
        out.append(part)
    return "'" + "".join(out).replace("'", "''") + "'"


MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with start and end in microseconds: the value counts minutes."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", micros("ts").alias("start"), (micros("ts") + F.round(F.col("value") * 100).cast("bigint") * 600_000).alias("end"))


TIMED = "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS start, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS \"end\" FROM events"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as timed words: each turn's words a third of a second apart."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    w = c.select("conv_id", "turn", "role", F.posexplode(F.filter(F.split("text", "\\s+"), lambda x: x != "")).alias("k", "text"))
    at = F.col("turn") * 60.0 + F.col("k") * 0.33
    return w.select("conv_id", (F.col("turn") * 100_000 + F.col("k")).alias("pos"), "turn", F.col("role").alias("speaker"), "text", at.alias("start"), (at + 0.3).alias("end"), F.array().cast("array<string>").alias("flags"))


WORDS = """SELECT conv_id, turn, speaker, turn * 100000 + k AS pos, text, turn::DOUBLE * 60 + k::DOUBLE * 0.33::DOUBLE AS start, turn::DOUBLE * 60 + k::DOUBLE * 0.33::DOUBLE + 0.3::DOUBLE AS "end"
FROM (SELECT conv_id, turn, role AS speaker, unnest(ws) AS text, unnest(range(len(ws))) AS k
      FROM (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations WHERE text IS NOT NULL))"""
