"""Streaming operators on small file streams."""

import datetime as dt

from pyspark.sql import functions as F

from colloquy.operators import state as G
from colloquy.streaming import streams as R

T0 = dt.datetime(2025, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def drained(df, tmp_path, mode="append"):
    q = df.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


def source(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stable_files(spark, tmp_path):
    s = source(spark, tmp_path, [[("a", 1, T0, at(0)), ("b", 1, T0, at(0))], [("a", 2, T0, at(10)), ("b", 1, T0, at(10))], [("a", 2, T0, at(20)), ("b", 1, T0, at(20))]], "path string, length long, modified timestamp, seen_at timestamp")
    assert sorted((r["path"], r["length"]) for r in drained(R.stable(s, 10), tmp_path).collect()) == [("a", 2), ("b", 1)]


def test_leases_and_missing(spark, tmp_path):
    s = source(spark, tmp_path / "l", [[("x", "o1", at(0), at(0)), ("x", "o2", at(1), at(0))], [("x", "o2", at(61), at(0)), ("y", "o1", at(0), at(5))]], "attempt_id string, owner_id string, at timestamp, due_at timestamp")
    assert [(r["attempt_id"], r["owner_id"]) for r in drained(R.poll_leases(s, 60), tmp_path / "l").orderBy("granted_at").collect()] == [("x", "o1"), ("x", "o2")]
    m = source(spark, tmp_path / "m", [[("x", at(0), False), ("y", at(0), False)], [("x", at(50), False), ("y", at(50), True)], [("x", at(100), False), ("y", at(100), False)]], "attempt_id string, at timestamp, found boolean")
    assert [r["attempt_id"] for r in drained(R.missing_after(m, 3, 90), tmp_path / "m").collect()] == ["x"]


def test_sessions_and_once(spark, tmp_path):
    rows = [[("u", at(0)), ("u", at(5))], [("u", at(100))], [("u", at(1000))]]
    s = source(spark, tmp_path / "s", rows, "user string, ts timestamp")
    got = drained(R.session_counts(s, ["user"], "ts", "30 seconds", "10 seconds"), tmp_path / "s")
    assert sorted(r["n"] for r in got.collect()) == [1, 2]
    o = source(spark, tmp_path / "o", [[("u", at(0)), ("u", at(1))], [("u", at(2)), ("v", at(2))]], "user string, ts timestamp")
    assert drained(R.once(o, ["user"], "ts", "1 hour"), tmp_path / "o").count() == 2


def test_upserts(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (1, "d", 3)]], "k int, v string, n int")
    q = R.upsert_batches(s, str(tmp_path / "t"), ["k"], ["n"], str(tmp_path / "cp"), lambda old, new: G.upsert(old, new, ["k"])).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max((tmp_path / "t").iterdir(), key=lambda p: int(p.name[2:]))
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(last)).collect()) == [(1, "d"), (2, "b")]


def test_upserts_go_on_with_a_new_checkpoint(spark, tmp_path):
    s = source(spark, tmp_path, [[(1, "a", 1), (2, "b", 1)]], "k int, v string, n int")
    run = lambda cp: R.upsert_batches(s, str(tmp_path / "t"), ["k"], ["n"], str(tmp_path / cp), lambda old, new: G.upsert(old, new, ["k"])).trigger(availableNow=True).start().awaitTermination(120)
    run("one")
    spark.createDataFrame([(1, "z", 9)], "k int, v string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run("two")  # its batches begin at 0 again
    assert sorted((r["k"], r["v"]) for r in R.newest(spark, str(tmp_path / "t")).collect()) == [(1, "z"), (2, "b")]


def test_absences_count_from_the_first_after_a_find(spark, tmp_path):
    m = source(spark, tmp_path, [[("x", at(0), True)], [("x", at(100), False)], [("x", at(160), False)], [("x", at(4000), False)]], "attempt_id string, at timestamp, found boolean")
    got = drained(R.missing_after(m, 2, 3600), tmp_path).collect()
    assert [(r["attempt_id"], r["n"], r["missing_at"]) for r in got] == [("x", 3, at(4000))]
