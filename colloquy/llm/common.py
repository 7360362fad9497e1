"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many rows of a few longs each.
BROADCAST_ROWS = 500_000
HEAVY = 200_000  # edges of one node that one task takes
EDGES_PER_TASK = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one beside the tables of the warehouse."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoint"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles and broadcasts of jobs that are done.

    Executors keep their files, and the driver its share, until the driver's JVM collects the garbage that
    refers to them, which a driver of small live data seldom does.
    """
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package; they need not share a folder with the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="colloquy-ship-"), "colloquy_pkg.zip")
    with open(path, "wb") as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt over all of them; a scan of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def text_key(text: Column) -> list[Column]:
    """t1, t2: hash and length, which tell texts apart."""
    return [F.xxhash64(text).alias("t1"), F.octet_length(text).alias("t2")]


def without_rows(docs: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """``docs`` less the rows whose ``keys`` (expressions over docs) equal the columns of a row of ``gone``; null equals null."""
    gone = stored(gone.toDF(*[f"_gone{k}" for k in range(len(keys))]).distinct(), "gone")
    same = [key.eqNullSafe(gone[f"_gone{k}"]) for k, key in enumerate(keys)]
    return docs.join(maybe_broadcast(gone), same, "left_anti")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a > b) of a task to (node, its smallest connected node here, whether that changes or may change an edge)."""
    got = [(b.column("a").to_numpy(), b.column("b").to_numpy(), b.column("split").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not got:
        return
    a, b, split = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], m)
        np.minimum.at(low, low[y], m)
        while (low[low] != low).any():
            low = low[low]
        if (low[x] == low[y]).all():
            break
    moved = np.zeros(len(nodes), bool)
    np.logical_or.at(moved, x, (low[x] != y) | split.astype(bool))
    leaf = np.flatnonzero(low != np.arange(len(nodes)))
    for k in range(0, len(leaf), 10_000):
        i = leaf[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[low[i]]), pa.array(moved[i])], names=["a", "b", "moved"])


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long).

    In each round an edge goes to the tasks of both its nodes, and every task
    links the nodes it holds to the smallest node that it sees them connected
    with.  The edges left are stars at the end.  Returns (node, root): every node
    that has an edge, root the smallest node of its component (the root itself
    is included).

    A node of more than HEAVY edges is split over several tasks: its edges to
    larger nodes by those nodes, each task also getting its edges to smaller ones.
    """
    ship(edges.sparkSession)
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    n = None
    for _ in range(rounds):
        one = F.lit(1).cast("long")
        e = e.select("a", "b", one.alias("ups"), one.alias("downs"), one.alias("own_ups"))
        if n is not None and n > HEAVY:
            up = stored(e.groupBy("b").agg(F.count("*").alias("k")).where(F.col("k") > HEAVY).select(F.col("b").alias("h"), F.ceil(F.col("k") / HEAVY).alias("k")), "heavy")  # at most n / HEAVY rows
            down = stored(e.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > HEAVY).select(F.col("a").alias("h"), F.ceil(F.col("k") / HEAVY).alias("k")), "heavy")
            for column, heavy, key in (("ups", up, "b"), ("downs", down, "a"), ("own_ups", up, "a")):
                e = e.drop(column).join(F.broadcast(heavy.withColumnRenamed("k", column)), F.col(key) == F.col("h"), "left").drop("h").withColumn(column, F.coalesce(column, one))
        salt = lambda other, k: F.pmod(F.xxhash64(other), F.col(k))
        place = lambda node, k: F.struct(F.col(node).alias("at"), k.alias("salt"), (F.col("downs") > 1).alias("split") if node == "a" else F.lit(False).alias("split"))
        at_a = F.when(F.col("downs") > 1, F.array(salt("b", "downs"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("own_ups") - 1))
        places = F.concat(F.transform(at_a, lambda k: place("a", k)), F.array(place("b", salt("a", "ups"))))
        both = e.select("a", "b", F.explode(places).alias("p")).select("p.at", "p.salt", "p.split", "a", "b").repartition(max(parts, (n or 0) // EDGES_PER_TASK), "at", "salt")
        e = cut(both.select("a", "b", "split").mapInArrow(_local_stars, "a long, b long, moved boolean"))
        n, moved = e.agg(F.count("*"), F.max("moved")).first()
        release(edges.sparkSession)
        if not moved:
            break
    else:
        raise RuntimeError("connected_components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
