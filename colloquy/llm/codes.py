"""Vector codes by product quantisation in whole numbers.

Components become integers floor(scale * x); vectors are cut into equal parts,
and every part position has a codebook.  Blocks of parts lie in columns (one
array for each component), are written once to the shared folder and read as an
RDD of NumPy blocks.  In each round a block adds up its squared distances
component by component, takes the nearest entries, and adds its parts into int64
tensors of sums and counts with ``np.add.at``; the tensors of all blocks meet in
a ``treeAggregate``, whose size depends on the codebooks alone.  All of it is
integer arithmetic, so results depend neither on order nor on partitions.

Defined results: vectors that are null or hold null or non-finite components take
no part, nor do vectors of another length than most have (ties: the longest) or
whose length the number of parts doesn't divide.  A vec_id that occurs on several
rows is kept on each; the first codebooks take rows in order of vec_id, then of
components, a null vec_id last.  With fewer rows than entries the codebooks have as
many entries as rows; an empty table gives no rows.  Integers whose distances or
sums could leave 64 bits raise an error before anything is computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, ship, stored

BLOCK_ROWS = 4096  # vectors in a block


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, components of a part), int64."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(df: DataFrame, vec_col: str = "embedding", scale: float = 4096.0) -> DataFrame:
    """The columns of ``df`` whose vector is usable, and its integers as array<long> ``_whole``."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    # beyond 2^62 a double is far outside of what is accepted below
    whole = F.transform(vec, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-(2.0**62))), F.lit(2.0**62))))
    return df.where(fine).withColumn("_whole", whole)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """(components, rows), contiguous by component."""
    return np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).T)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, kind: str) -> Iterator[pa.RecordBatch]:
    wait: list[pa.Array] = []

    def out() -> pa.RecordBatch:
        block = _matrix(pa.concat_arrays(wait), dim).astype(kind)
        wait.clear()
        return pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    for b in batches:
        for k in range(0, b.num_rows, BLOCK_ROWS):
            wait.append(b.column(0).slice(k, BLOCK_ROWS))
            if sum(map(len, wait)) >= BLOCK_ROWS:
                yield out()
    if wait:
        yield out()


def nearest_entries(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every part and its squared distance, (parts, rows) each; ties go to the lower index."""
    parts, entries, width = books.shape
    codes, errors = np.empty((parts, columns.shape[1]), np.int64), np.empty((parts, columns.shape[1]), np.int64)
    for p in range(parts):
        far = np.zeros((entries, columns.shape[1]), np.int64)
        for d in range(width):
            apart = columns[p * width + d].astype(np.int64)[None, :] - books[p, :, d][:, None]
            far += apart * apart
        codes[p] = far.argmin(0)
        errors[p] = np.take_along_axis(far, codes[p][None, :], 0)[0]
    return codes, errors


def gathered(state: tuple[np.ndarray, np.ndarray] | None, columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, entries, width) and counts (parts, entries) with those of one more block."""
    parts, entries, width = books.shape
    sums, counts = state or (np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64))
    codes, _ = nearest_entries(columns, books)
    for p in range(parts):
        np.add.at(counts[p], codes[p], 1)
        for d in range(width):
            np.add.at(sums[p, :, d], codes[p], columns[p * width + d].astype(np.int64))
    return sums, counts


def _merged(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def _measure(whole: DataFrame, parts: int) -> tuple[int, int]:
    """Length of the vectors that take part (0: none), after a check that 64 bits hold all distances and sums."""
    v = F.col("_whole")
    by = whole.select(F.size(v).alias("k"), F.greatest(F.array_max(v), -F.array_min(v)).alias("m")).groupBy("k").agg(F.count("*").alias("n"), F.max("m").alias("m"))
    most = by.where(F.col("k") > 0).orderBy(F.col("n").desc(), F.col("k").desc()).first()
    if most is None or most["k"] % parts:
        return 0, 0
    reach = int(most["m"]) + 1
    if most["k"] * (2 * reach) ** 2 >= 2**63 or most["n"] * reach >= 2**63:
        raise ArithmeticError(f"components of up to {reach} in {most['n']} vectors of {most['k']}: 64-bit integers don't hold the distances or sums; take a smaller scale")
    return most["k"], reach


def fit(whole: DataFrame, dim: int, reach: int, id_col: str = "vec_id", parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks of the vectors of ``dim`` integers in ``whole`` (see ``integers``)."""
    spark = whole.sparkSession
    first = whole.select(F.col(f"`{id_col}`").alias("i"), F.col("_whole").alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    kind = "<i4" if reach < 2**31 else "<i8"
    blocks = stored(whole.select("_whole").mapInArrow(lambda it: _blocks(it, dim, kind), "block binary"), "codes")
    numpy_blocks = blocks.rdd.map(lambda r: np.frombuffer(r["block"], kind).reshape(dim, -1))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)  # of parts * entries vectors' parts
        sums, counts = numpy_blocks.treeAggregate(None, lambda state, block, held=held: gathered(state, block, held.value), _merged)
        held.unpersist()
        used = counts > 0
        books = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)
    return Codebooks(books)


def _encode(batches: Iterator[pa.RecordBatch], dim: int, books: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = np.array([f"{k:02x}" for k in range(256)])
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            b = batch.slice(k, BLOCK_ROWS)
            codes, errors = nearest_entries(_matrix(b.column(b.num_columns - 1), dim), books)
            code = ["".join(x) for x in names[codes.T].tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(code, pa.string()), pa.array(errors.sum(0), pa.int64())], names=[*b.schema.names[:-1], "code", "error"])


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 4096.0, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error (squared distances over all parts), label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    ship(df.sparkSession)
    whole = integers(df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("_vec")), "_vec", scale)
    dim, reach = _measure(whole, parts)
    kind = dict(whole.dtypes)["label"]
    schema = f"vec_id long, label {kind}, code string, error long"
    if not dim:
        return df.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    whole = whole.where(F.size("_whole") == dim)
    books = fit(whole, dim, reach, "vec_id", parts, entries, rounds)
    coded = stored(whole.select("vec_id", "label", "_whole").mapInArrow(lambda it: _encode(it, dim, books.entries), schema), "coded")
    # a label may hold most rows: its sum is gathered before the shuffle, and Spark splits a side's hot partitions in a shuffled join
    of_label = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    joined = coded.join(maybe_broadcast(of_label), F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def decode(coded: DataFrame, books: Codebooks, scale: float = 4096.0) -> DataFrame:
    """``coded`` with the vector that its ``code`` stands for, as ``decoded`` (array<double>)."""
    rows = [F.array(*[F.lit(x / scale) for x in entry]) for entry in books.entries.reshape(-1, books.entries.shape[2]).tolist()]
    table, n = F.array(*rows), books.entries.shape[1]
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * n + 1 for p in range(books.entries.shape[0])]
    return coded.withColumn("decoded", F.flatten(F.array(*[F.element_at(table, k) for k in at])))


def oracle_sql(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB SQL of ``compress`` over ``embeddings`` of one length."""
    near = """SELECT v.vec_id, v.label, v.p, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': b.k}}) AS m
  FROM v JOIN b{r} AS b ON b.p = v.p GROUP BY v.vec_id, v.label, v.p, v.x"""
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near.format(r=r)}),
s{r} AS (SELECT p, k, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT p, m.k AS k, unnest(x) AS y, unnest(range(len(x))) AS j FROM a{r}) GROUP BY p, k, j),
g{r} AS (SELECT p, k, list((s - (((s % n) + n) % n)) // n ORDER BY j) AS x FROM s{r} GROUP BY p, k),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(g.x, b.x) AS x FROM b{r} AS b LEFT JOIN g{r} AS g ON g.p = b.p AND g.k = b.k)""")
    body = ",\n".join(steps)
    return f"""
WITH i AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS x FROM i, (SELECT unnest(range({parts})) AS p)
), b0 AS MATERIALIZED (
  SELECT p, k, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x FROM v) WHERE k < {entries}
),
{body},
f AS ({near.format(r=rounds)}),
c AS (SELECT vec_id, label, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(x) AS y, unnest(range(len(x))) AS j FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h
"""
