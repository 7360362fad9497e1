"""Exact nearest neighbours by a block matrix join.

Vectors are taken in blocks.  A tile (query block x data block) multiplies
int8 codes (held in float32, where sums of int8 products are exact up to 1040
dimensions and float64 takes over beyond), which gives every squared distance
with a bound on its quantisation error.  Pairs whose lower bound is within the
best upper bounds so far are recomputed in double precision and merged into a
heap of the k nearest of each query.

Queries of up to BROADCAST_BYTES, a size that is counted first, go to all tasks
and data blocks stream past them.  Beyond, queries and data are dealt into groups
of bounded size, and each pair of groups is one task of a grid.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part.  Vectors of different length are not comparable.  A
vec_id that occurs on several rows counts once per query, at its smallest
distance, and asks with the smallest of its vectors (in order of components); a
query's own vec_id is never its candidate.  A null vec_id takes no part.  Ties
go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

DATA_ROWS = 4096  # vectors in a data block
QUERY_ROWS = 512  # vectors in a query block
BROADCAST_BYTES = 32 << 20  # of queries that every task gets; more go through the grid
DATA_BYTES = 64 << 20  # of data in a group of the grid
HELD_ENTRIES = 1_000_000  # entries of all heaps a task holds before it hands them on

FOUND = "query_id long, vec_id long, score double"


def _arrays(ids: pa.ChunkedArray | pa.Array, vec: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each length."""
    if isinstance(vec, pa.ChunkedArray):
        vec = vec.combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
    ids = ids.to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.to_numpy()
    sizes = np.diff(vec.offsets.to_numpy())
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield ids[at], flat[start[at][:, None] + np.arange(dim)]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as floats), step sizes, norms of what was coded, norms of the error."""
    step = np.abs(x).max(1) / 127.0
    codes = np.rint(x / np.where(step > 0, step, 1)[:, None])
    coded = codes * step[:, None]
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    return codes.astype(np.int8).astype(kind), step, np.sqrt((coded**2).sum(1)), np.sqrt(((x - coded) ** 2).sum(1))


class Heaps:
    """The k nearest of each query, as flat arrays in order of (query, score, vec_id)."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.q = np.zeros(0, np.int64)
        self.d = np.zeros(0)
        self.v = np.zeros(0, np.int64)
        self.worst = np.full(len(queries), np.inf)

    def merge(self, q: np.ndarray, d: np.ndarray, v: np.ndarray) -> None:
        q, d, v = np.concatenate([self.q, q]), np.concatenate([self.d, d]), np.concatenate([self.v, v])
        first = np.lexsort((d, v, q))
        q, d, v = q[first], d[first], v[first]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
        q, d, v = q[new], d[new], v[new]
        order = np.lexsort((v, d, q))
        q, d, v = q[order], d[order], v[order]
        start = np.searchsorted(q, np.arange(len(self.queries)))
        rank = np.arange(len(q)) - start[q]
        keep = rank < self.k
        self.q, self.d, self.v = q[keep], d[keep], v[keep]
        full = rank[keep] == self.k - 1
        self.worst[self.q[full]] = self.d[full]


def tile(heaps: Heaps, qx: np.ndarray, qcode: tuple, ids: np.ndarray, x: np.ndarray, xcode: tuple, pairs: int = 1 << 15) -> None:
    """Puts the candidates of one tile into the heaps."""
    codes, step, norm, err = xcode
    qcodes, qstep, qnorm, qerr = qcode
    k = heaps.k
    square = (x**2).sum(1)
    distinct = len(np.unique(ids)) == len(ids)
    for a in range(0, len(qx), 64):
        b = min(a + 64, len(qx))
        product = (qcodes[a:b] @ codes.T).astype(np.float64) * qstep[a:b, None] * step[None, :]
        bound = qerr[a:b, None] * norm[None, :] + qnorm[a:b, None] * err[None, :] + qerr[a:b, None] * err[None, :]
        base = (qx[a:b] ** 2).sum(1)[:, None] + square[None, :]
        slack = 1e-9 * (base + 1)
        middle = base - 2 * product
        low, high = middle - 2 * bound - slack, middle + 2 * bound + slack
        own = ids[None, :] == heaps.queries[a:b, None]
        high[own] = np.inf
        limit = heaps.worst[a:b] ** 2 * (1 + 1e-9) + 1e-12
        if distinct and len(ids) > k:
            limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero(~(low > limit[:, None]) & ~own)  # bounds that overflowed don't exclude a pair
        for s in range(0, len(r), pairs):
            rr, cc = r[s : s + pairs], c[s : s + pairs]
            apart = np.ascontiguousarray((qx[a + rr] - x[cc]).T)
            d = np.sqrt((apart * apart).sum(0))  # adds component after component
            near = d <= heaps.worst[a + rr]
            if near.any():
                heaps.merge(a + rr[near], d[near], ids[cc[near]])


class Asked:
    """Query blocks by dimension, with a heap for each that data was compared with."""

    def __init__(self, groups: list[tuple[np.ndarray, np.ndarray]], k: int) -> None:
        self.k, self.blocks, self.entries = k, {}, 0
        for ids, x in groups:
            self.blocks.setdefault(x.shape[1], []).extend((ids[a : a + QUERY_ROWS], x[a : a + QUERY_ROWS]) for a in range(0, len(ids), QUERY_ROWS))
        self.codes = {d: [quantised(x) for _, x in blocks] for d, blocks in self.blocks.items()}
        self.heaps: dict[tuple[int, int], Heaps] = {}

    def meet(self, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compares data of one dimension with all queries; hands heaps on when they grow too many."""
        dim = x.shape[1]
        for a in range(0, len(ids) if dim in self.blocks else 0, DATA_ROWS):
            i, y = ids[a : a + DATA_ROWS], x[a : a + DATA_ROWS]
            code = quantised(y)
            for n, (qids, qx) in enumerate(self.blocks[dim]):
                if (dim, n) not in self.heaps:
                    if self.entries > HELD_ENTRIES:
                        yield self.done()
                    self.heaps[dim, n] = Heaps(qids, self.k)
                    self.entries += len(qids) * self.k
                tile(self.heaps[dim, n], qx, self.codes[dim][n], i, y, code)

    def done(self) -> pa.RecordBatch:
        parts = [(h.queries[h.q], h.v, h.d) for h in self.heaps.values()] or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.heaps, self.entries = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["query_id", "vec_id", "score"])


def _stream(batches: Iterator[pa.RecordBatch], held, k: int) -> Iterator[pa.RecordBatch]:
    asked = Asked(held.value, k)
    wait: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def meet(dim: int) -> Iterator[pa.RecordBatch]:
        ids, x = zip(*wait.pop(dim), strict=True)
        yield from asked.meet(np.concatenate(ids), np.concatenate(x))

    for b in batches:
        for ids, x in _arrays(b.column(0), b.column(1)):
            wait.setdefault(x.shape[1], []).append((ids, x))
            if sum(len(i) for i, _ in wait[x.shape[1]]) >= DATA_ROWS:
                yield from meet(x.shape[1])
    for dim in list(wait):
        yield from meet(dim)
    yield asked.done()


def _cell(data: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """One group of data against one of queries."""
    if not data.num_rows or not queries.num_rows:
        return pa.Table.from_batches([Asked([], k).done()])
    asked = Asked(list(_arrays(queries.column("vec_id"), queries.column("vec"))), k)
    out = [b for ids, x in _arrays(data.column("vec_id"), data.column("vec")) for b in asked.meet(ids, x)]
    return pa.Table.from_batches([*out, asked.done()])


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for every row of ``queries``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    data = usable(vectors, id_col, vec_col)
    asked = usable(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    bytes_of = lambda df: df.agg(F.coalesce(F.sum(F.size("vec").cast("long") * 8 + 16), F.lit(0))).first()[0]
    size = bytes_of(asked)
    if size <= BROADCAST_BYTES:
        got = asked.toArrow()
        held = spark.sparkContext.broadcast(list(_arrays(got.column("vec_id"), got.column("vec"))) if got.num_rows else [])
        found = data.mapInArrow(lambda it: _stream(it, held, k), FOUND)
    else:
        rows, columns = int(size // BROADCAST_BYTES) + 1, int(bytes_of(data) // DATA_BYTES) + 1
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # equal rows may be many: data is dealt at random, by a seed that a lost task repeats
        left = data.withColumn("dealt", F.floor(F.rand(7) * columns).cast("int")).withColumn("asked", every(rows))
        right = asked.withColumn("asked", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")).withColumn("dealt", every(columns))
        cells = left.groupBy("asked", "dealt").cogroup(right.groupBy("asked", "dealt"))
        found = cells.applyInArrow(lambda a, b: _cell(a, b, k), FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
