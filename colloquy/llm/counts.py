"""Token counts as rollups that deltas maintain.

A batch of changes (insert, delete, or a revised count of a document under a
tokenizer version) becomes signed sums by (source, lang, version).  The store is
a folder: each batch's sums are Parquet in a folder of its own, and a chain of
manifests says which folders count and which batch ids were committed.  A commit
writes its data first, then a complete manifest under a temporary name, and
gives that the next number; of two writers of one number the second starts over
from the other's.  So readers see all of a batch or nothing, a batch that broke
off counts for nothing, and one that is committed changes nothing when applied
again.  Totals are the sums over live folders; groups that come to nothing are
left out.

Sums are pre-aggregated before the shuffle, so a hot source costs no more.

Defined results: a null or empty text has no tokens but counts as a document;
null sources and languages are groups of their own; repeated rows count again.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, ship

KEYS = ("source", "lang", "tokenizer_version")
_held: dict[str, tiktoken.Encoding] = {}


def encoding(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    if ranks_file not in _held:
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _held[ranks_file] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _held[ranks_file]


def _count(batches: Iterator[pa.RecordBatch], ranks_file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    e = encoding(ranks_file, pattern)
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            b = batch.slice(k, 256)
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "tokens"])


def count_tokens(documents: DataFrame, ranks_file: str, pattern: str, version: str) -> DataFrame:
    """source, lang, tokenizer_version, tokens: one row per document."""
    ship(documents.sparkSession)
    rows = documents.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _count(it, ranks_file, pattern), "source string, lang string, tokenizer_version string, tokens long")


def count_words(documents: DataFrame, version: str = "words") -> DataFrame:
    """The same with runs other than ASCII white space as tokens, by Spark's own functions."""
    n = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return documents.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version"), n.cast("long").alias("tokens"))


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.col("tokens"), F.lit(1).alias("sign"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.col("tokens"), F.lit(-1).alias("sign"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """What takes the counts ``before`` back and puts ``after`` in their place."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark, path: str | None = None) -> None:
        self.spark, self.path = spark, (path or fresh_dir(spark, "rollup")).rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest; 0 where there is none."""
        folder = self._place("manifests")
        fs = folder.getFileSystem(self.conf)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        n = max((int(x) for x in names if x.isdigit()), default=0)
        if not n:
            return 0, {"batches": [], "folders": []}
        stream = fs.open(self._place(f"manifests/{n:09d}"))
        try:
            return n, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, number: int, content: dict) -> bool:
        """Makes ``content`` the manifest of that number; False if there is one."""
        fresh, to = self._place(f"manifests/_{uuid.uuid4().hex}"), self._place(f"manifests/{number:09d}")
        out = fresh.getFileSystem(self.conf).create(fresh)
        out.writeBytes(json.dumps(content))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(self.conf).makeQualified(to).toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fresh, to, none)  # never over what is there
        except Exception:
            if not to.getFileSystem(self.conf).exists(to):
                raise
            return False
        return True

    def committed(self) -> list[str]:
        return self._manifest()[1]["batches"]

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits ``changes`` (source, lang, tokenizer_version, tokens, sign) once; False if the batch was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"a batch id has letters, digits, '_', '.' and '-': {batch!r}")
        if batch in self.committed():
            return False
        folder = f"data-{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        sums.write.parquet(f"{self.path}/{folder}")
        while True:
            n, now = self._manifest()
            if batch in now["batches"]:
                return False
            if self._put(n + 1, {"batches": [*now["batches"], batch], "folders": [*now["folders"], folder]}):
                return True

    def _sums(self, folders: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer_version string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs, tokens."""
        return self._sums(self._manifest()[1]["folders"])

    def compact(self, batch: str) -> None:
        """Puts one folder in the place of all live ones, as batch ``batch``; ids that were committed stay known, batches committed meanwhile stay."""
        old = self._manifest()[1]
        if batch in old["batches"]:
            raise ValueError(f"batch id already used: {batch!r}")
        folder = f"data-{uuid.uuid4().hex}"
        self._sums(old["folders"]).write.parquet(f"{self.path}/{folder}")
        while True:
            n, now = self._manifest()
            if batch in now["batches"] or not set(old["folders"]) <= set(now["folders"]):
                raise RuntimeError("another compaction came first")
            rest = [f for f in now["folders"] if f not in old["folders"]]
            if self._put(n + 1, {"batches": [*now["batches"], batch], "folders": [folder, *rest]}):
                return

    def vacuum(self) -> None:
        """Deletes folders that no manifest counts any more; call it when no reader or writer is at work."""
        live = set(self._manifest()[1]["folders"])
        root = self._place("")
        fs = root.getFileSystem(self.conf)
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in live:
                fs.delete(s.getPath(), True)
