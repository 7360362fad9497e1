"""Sharding on a consistent-hash ring with bounded loads, with DataFrame functions only.

The ring has RING slots; each shard owns virtual nodes on it, and a slot belongs
to the next node clockwise.  A row's slot is the hash of its key.  Shards take
the rows of their own slots up to their capacity; what is left of a slot goes on
clockwise to the next node whose shard has room.  Capacities are those of equal
counts (the first ``rows mod shards`` shards hold one more), so shards differ
by one row at most, while most rows stay where plain hashing puts them.

Only counts per slot reach the driver: a table of RING numbers, whatever the
input.  Within a slot rows are ranked by (hash, key, size, checksum), so the plan
is a list of rank ranges and a row's shard and place follow from its rank.

Defined results: a null key hashes like a key of its own; repeated rows are
ranked one after another; a null text has size 16 and the checksum of no bytes.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RING = 1 << 15
NODES = 100  # virtual nodes of each shard


def nodes(spark, shards: int, virtual: int = NODES, ring: int = RING) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise."""
    at = spark.range(shards * virtual).select(F.pmod(F.xxhash64(F.concat_ws("/", F.lit("node"), (F.col("id") / virtual).cast("int"), F.col("id") % virtual)), F.lit(ring)).alias("slot"), (F.col("id") / virtual).cast("int").alias("shard"))
    return sorted((int(r[0]), int(r[1])) for r in at.collect())


def plan(counts: dict[int, int], ring_nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, from rank, to rank, shard, place of the first): where the rows of each slot go."""
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    places = [p for p, _ in ring_nodes]
    out, left = [], []

    def put(slot: int, start: int, n: int, shard: int) -> None:
        out.append((slot, start, start + n, shard, used[shard]))
        used[shard] += n
        free[shard] -= n

    for slot in sorted(counts):
        k = bisect.bisect_left(places, slot) % len(ring_nodes)
        shard = ring_nodes[k][1]
        n = min(counts[slot], free[shard])
        if n:
            put(slot, 0, n, shard)
        if n < counts[slot]:
            left.append((slot, n, counts[slot] - n, k))
    for slot, start, n, k in left:
        while n:
            k = (k + 1) % len(ring_nodes)
            shard = ring_nodes[k][1]
            if got := min(n, free[shard]):
                put(slot, start, got, shard)
                start, n = start + got, n - got
    return out


def assign(df: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot (place in the shard from 0), grown_shard (null), home_shard (by plain hashing)."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("null")))
    rows = df.select(F.col(key_col).alias("doc_id"), hashed.alias("h"), F.pmod(hashed, F.lit(RING)).cast("int").alias("ring"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    counts = {int(r[0]): int(r[1]) for r in df.select(F.pmod(hashed, F.lit(RING)).cast("int").alias("ring")).groupBy("ring").count().collect()}
    around = nodes(spark, shards)
    places = [p for p, _ in around]
    where = [(slot, a, b, s, first, around[bisect.bisect_left(places, slot) % len(around)][1]) for slot, a, b, s, first in plan(counts, around, shards)]
    ranges = spark.createDataFrame(where, "ring int, a bigint, b bigint, shard int, first bigint, home_shard int")
    ranges = stored(ranges, "ring")  # at most RING rows and those that overflow
    order = Window.partitionBy("ring").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    placed = ranked.join(F.broadcast(ranges.withColumnRenamed("ring", "r0")), (F.col("ring") == F.col("r0")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("rank") - F.col("a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")
