"""Incremental operators: stable files, deduplicated ingest, streaming sessions, idempotent upserts.

Event time has a watermark, which is an addition of ours: state older than it is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, per_trigger: int = 100, pattern: str = "*", latest_first: bool = False) -> DataFrame:
    """A stream of files: path, modified, length, content."""
    s = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).option("latestFirst", latest_first)
    return s.load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def stable(observed: DataFrame, stable_seconds: float) -> DataFrame:
    """(path, length, modified) once a path's signature has stayed the same for ``stable_seconds``.

    observed: path, length, modified, seen_at (a poll's listing).  A changed signature starts anew; a
    path is given out once for each signature.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, modified, since, done = state.get if state.exists else (None, None, None, False)
        out = []
        for pdf in pdfs:
            for r in pdf.sort_values("seen_at").itertuples():
                if (r.length, r.modified) != (length, modified):
                    length, modified, since, done = int(r.length), r.modified, r.seen_at, False
                elif not done and (r.seen_at - since).total_seconds() >= stable_seconds:
                    done = True
                    out.append((key[0], length, modified))
        state.update((length, modified, since, done))
        yield pd.DataFrame(out, columns=["path", "length", "modified"])

    return observed.groupBy("path").applyInPandasWithState(step, "path string, length long, modified timestamp", "length long, modified timestamp, since timestamp, done boolean", "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Rows of the stream once per key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def session_counts(stream: DataFrame, keys: Sequence[str], time: str, gap: str, late: str) -> DataFrame:
    """Sessions per key by a gap in event time: start, end, n."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(stream: DataFrame, keys: Sequence[str], time: str, size: str, step: str, late: str) -> DataFrame:
    """Tumbling or sliding windows in event time."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, size, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def poll_leases(requests: DataFrame, lease_seconds: float) -> DataFrame:
    """Grants at most one lease per attempt at a time: (attempt_id, owner_id, granted_at).

    requests: attempt_id, owner_id, at, due_at.  Granted if due and no lease is running.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        out = []
        for pdf in pdfs:
            for r in pdf.sort_values(["at", "owner_id"]).itertuples():
                if r.at >= r.due_at and (until is None or r.at >= until):
                    until = r.at + pd.Timedelta(seconds=lease_seconds)
                    out.append((key[0], r.owner_id, r.at))
        if until is not None:
            state.update((until,))
        yield pd.DataFrame(out, columns=["attempt_id", "owner_id", "granted_at"])

    return requests.groupBy("attempt_id").applyInPandasWithState(step, "attempt_id string, owner_id string, granted_at timestamp", "until timestamp", "append", GroupStateTimeout.NoTimeout)


def missing_after(reports: DataFrame, times: int, seconds: float) -> DataFrame:
    """Attempts that were reported missing ``times`` times over at least ``seconds``, once each.  reports: attempt_id, at, found."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, done = state.get if state.exists else (0, None, False)
        first = None if pd.isna(first) else first
        out = []
        for pdf in pdfs:
            for r in pdf.sort_values("at").itertuples():
                if r.found:
                    n, first = 0, None
                    continue
                n, first = n + 1, first if first is not None else r.at
                if not done and n >= times and (r.at - first).total_seconds() >= seconds:
                    done = True
                    out.append((key[0], n, r.at))
        state.update((n, first, done))
        yield pd.DataFrame(out, columns=["attempt_id", "n", "missing_at"])

    return reports.groupBy("attempt_id").applyInPandasWithState(step, "attempt_id string, n int, missing_at timestamp", "n int, first timestamp, done boolean", "append", GroupStateTimeout.NoTimeout)


def _generations(spark: SparkSession, path: str) -> tuple[dict[int, set[str]], Callable, Callable]:
    """Names of the files in each committed generation; makers of paths and of their file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = place(path)
    fs = system(root)
    held = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith("g=")]
    return {int(p.getName()[2:]): {s.getPath().getName() for s in fs.listStatus(p)} for p in held}, place, system


def upsert_batches(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame]):
    """Keeps a Parquet table in generations: each micro-batch merges into the last one and commits a new folder, once per checkpoint and batch id.

    A folder g=<generation> is written under another name, gets a file that tells its checkpoint and batch, and
    is then renamed, so it is there whole or not at all.  Generations go on rising when a stream starts anew with
    another checkpoint, whose batch ids begin at 0 again.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done, place, system = _generations(spark, path)
        origin = f"_origin-{name}-{batch_id}"
        if any(origin in files for files in done.values()):
            return
        last = max(done, default=0)
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("_r")).select("_r.*")
        before = spark.read.parquet(f"{path}/g={last}").select(*batch.columns) if last else batch.limit(0)
        fresh = place(f"{path}/_writing-{name}-{batch_id}")
        merge(before, latest).write.mode("overwrite").parquet(fresh.toString())
        system(fresh).create(place(fresh, origin)).close()
        if not system(fresh).rename(fresh, place(f"{path}/g={last + 1}")):
            raise RuntimeError(f"generation {last + 1} could not be committed")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation of ``upsert_batches``."""
    return spark.read.parquet(f"{path}/g={max(_generations(spark, path)[0])}")
