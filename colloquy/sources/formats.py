"""Files in and out: transcripts (JSON and text), RTTM, subtitles, event logs.

Readers use declared schemas; rows that break a rule go to a reject frame
beside the good ones, with the reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

TRANSCRIPT = "schema_version int, source string, duration_seconds double, speakers map<string,string>, utterances array<struct<start:double,`end`:double,speaker:string,text:string,flags:array<string>>>"
EVENT = (
    "schema_version int, event_id string, timestamp string, run_id string, attempt_id string, job_id string, component string, category string, name string, severity string, "
    "outcome string, inputs map<string,string>, metrics map<string,string>, thresholds map<string,string>, reasons array<string>, refs map<string,string>, duration_ms double"
)


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(utterances, rejects).  Times become whole milliseconds, ids U%05d follow the place in the file.

    A file is rejected with its first reason: no utterances, a time that is missing, negative or not
    finite, an end before its start, a start before the one before, or a duration before the last end.
    """
    docs = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    # a file is a row, and is judged by itself: no shuffle, and one look at it
    start = F.transform("utterances", lambda x: S.milliseconds(x["start"]))
    before = F.slice(F.concat(F.array(F.lit(None).cast("bigint")), start), F.lit(1), F.size("utterances"))

    def judged(x: Column, last: Column) -> Column:
        a, b = S.milliseconds(x["start"]), S.milliseconds(x["end"])
        return (
            F.when(a.isNull() | b.isNull(), "time").when(b < a, "end before start").when(a < last["ms"], "order").when(last["duration"] * 1000 < b - 0.5, "duration")
        )

    beside = F.transform(before, lambda ms: F.struct(ms.alias("ms"), F.col("duration_seconds").alias("duration")))
    found = F.filter(F.zip_with("utterances", beside, judged), lambda r: r.isNotNull())
    reason = F.when(F.coalesce(F.size("utterances"), F.lit(0)) <= 0, "no utterances").otherwise(F.get(found, F.lit(0)))
    docs = docs.withColumn("reason", reason)
    rejects = docs.where("reason is not null").select("path", "reason")
    u = docs.where("reason is null").select("path", "source", "speakers", F.posexplode("utterances").alias("pos", "u")).select("path", "source", "speakers", "pos", "u.*")
    label = F.coalesce(F.try_element_at("speakers", F.col("speaker")), F.col("speaker"))
    good = u.select(
        "path", "source", S.meeting_date("source").alias("meeting_date"), F.format_string("U%05d", F.col("pos") + 1).alias("utterance_id"), "pos", S.milliseconds("start").alias("start_ms"), S.milliseconds("end").alias("end_ms"),
        label.alias("speaker"), F.col("text").alias("text_raw"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "(?U)\\s+", " ")).alias("text"), "flags",
    )
    return good, rejects


def read_text_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``[hh:mm:ss] speaker: text``: start (seconds), speaker, text."""
    t = spark.read.text(path)
    pattern = "^\\[(\\d{1,2}):(\\d{2}):(\\d{2})(?:[.,]\\d+)?\\]\\s*([^:]+):\\s*(.*)$"
    g = lambda k: F.regexp_extract("value", pattern, k)
    return t.where(F.col("value").rlike(pattern)).select((g(1).cast("int") * 3600 + g(2).cast("int") * 60 + g(3).cast("int")).alias("start"), F.trim(g(4)).alias("speaker"), g(5).alias("text"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """SPEAKER rows with eight fields or more: recording, start, end, speaker."""
    f = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 8) & (F.get("f", F.lit(0)) == "SPEAKER"))
    return rows.select(F.get("f", F.lit(1)).alias("recording"), F.get("f", F.lit(3)).cast("double").alias("start"), (F.get("f", F.lit(3)).cast("double") + F.get("f", F.lit(4)).cast("double")).alias("end"), F.get("f", F.lit(7)).alias("speaker"))


def rttm_lines(segments: DataFrame, session: str) -> DataFrame:
    """One RTTM line per segment (start, end, speaker): column value."""
    return segments.select(F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.lit(session), F.col("start"), F.col("end") - F.col("start"), F.col("speaker")).alias("value"))


def srt_blocks(captions: DataFrame, keys: Sequence[str] = ("recording",), order: str = "caption") -> DataFrame:
    """Subtitles of each recording in order: number, value (a block of an SRT file)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return captions.select(*keys, n.alias("number"), F.concat_ws("\n", n.cast("string"), F.concat(S.timestamp("start", True), F.lit(" --> "), S.timestamp("end", True)), "text", F.lit("")).alias("value"))


def markdown_lines(utterances: DataFrame) -> DataFrame:
    return utterances.select("utterance_id", F.concat(F.lit("**"), F.coalesce("speaker", F.lit("?")), F.lit("** ["), S.timestamp(F.col("start_ms") / 1000), F.lit("] "), "text").alias("value"))


# what stands for characters that would end a line or begin a link
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("[", "\\["), ("\u0001", "\\1"))


def _escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _plain(text: Column) -> Column:
    text = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))  # a written backslash is out of the way first
    for plain, written in ESCAPES[1:-1]:
        text = F.replace(text, F.lit(written), F.lit(plain))
    text = F.replace(text, F.lit("\\1"), F.lit("\u0002"))
    return F.replace(F.replace(text, F.lit("\u0001"), F.lit("\\")), F.lit("\u0002"), F.lit("\u0001"))


def render_documents(items: DataFrame, keys: Sequence[str], title: Column) -> DataFrame:
    """(keys, document): one Markdown text of each document's items: section, place, text and a link to target, where there is one.

    items: section, section_place, place, text, target.  Sections come in order of section_place, a text is one line.
    """
    link = F.when(F.col("target").isNotNull(), F.concat(F.lit(" [#](#"), "target", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), _escaped(F.coalesce("text", F.lit(""))), link)
    per = items.withColumn("_t", title).groupBy(*keys, "section", "section_place").agg(F.first("_t").alias("_t"), F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]).alias("_l"))
    part = F.concat(F.array(F.concat(F.lit("## "), _escaped(F.col("section")))), "_l")
    docs = per.groupBy(*keys).agg(F.first("_t").alias("_t"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_place", "section", part.alias("l")))), lambda x: x["l"])).alias("_l"))
    return docs.select(*keys, F.array_join(F.concat(F.array(F.concat(F.lit("# "), _escaped(F.col("_t")))), "_l"), "\n").alias("document"))


def parse_documents(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, title, section, place, text, target): the items of Markdown documents, numbered within their section; other lines are none."""
    found = r"^- (.*?)(?: \[#\]\(#([^)]*)\))?$"
    rows = documents.select(*keys, F.posexplode(F.split("document", "\n")).alias("_k", "_l"))
    w = Window.partitionBy(*keys).orderBy("_k")
    title = F.first(F.when(F.col("_l").startswith("# "), F.expr("substring(_l, 3)")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    heading = F.last(F.when(F.col("_l").startswith("## "), F.struct(F.expr("substring(_l, 4)").alias("name"), F.col("_k").alias("at"))), ignorenulls=True).over(w)
    rows = rows.withColumn("title", title).withColumn("_h", heading).where(F.col("_l").startswith("- ") & F.col("_h").isNotNull())
    place = F.row_number().over(Window.partitionBy(*keys, "_h.at").orderBy("_k")) - 1
    target = F.nullif(F.regexp_extract("_l", found, 2), F.lit(""))
    return rows.select(*keys, _plain(F.col("title")).alias("title"), _plain(F.col("_h.name")).alias("section"), place.alias("place"), _plain(F.regexp_extract("_l", found, 1)).alias("text"), target.alias("target"))


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, malformed lines) of an event log in JSON lines."""
    parsed = F.from_json("value", EVENT + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).where("trim(value) <> ''").select("value", parsed.alias("e"))
    broken = F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    return rows.where(~broken).select("e.*").drop("_corrupt"), rows.where(broken).select(F.col("value").alias("_corrupt"))


def write_events(events: DataFrame, path: str, trace: tuple[str, ...] = ("trace", "decision")) -> None:
    """Appends events to ``path``/main or ``path``/trace by category."""
    events.where(~F.col("category").isin(*trace)).write.mode("append").json(f"{path}/main")
    events.where(F.col("category").isin(*trace)).write.mode("append").json(f"{path}/trace")


def ingest(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs of files (path, name, content): digest and submission fingerprint, once each and only if not known."""
    f = files.select("path", "name", F.sha2("content", 256).alias("content_sha256")).withColumn("fingerprint", S.submission_fingerprint("content_sha256", "name"))
    return f.groupBy("fingerprint").agg(F.min_by(F.struct("path", "name", "content_sha256"), "path").alias("_f")).select("fingerprint", "_f.*").join(jobs.select("fingerprint"), "fingerprint", "left_anti")


def find_jobs(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """The earliest job for each file (file_id, fingerprint, content_sha256, name, path): same fingerprint, or same digest with same name or path."""
    j = jobs.select("id", F.col("fingerprint").alias("_f"), F.col("content_sha256").alias("_d"), F.col("name").alias("_n"), F.col("path").alias("_p"))
    a = files.join(j, F.col("fingerprint") == F.col("_f")).select("file_id", "id")
    b = files.join(j, (F.col("content_sha256") == F.col("_d")) & (F.col("name") == F.col("_n"))).select("file_id", "id")
    c = files.join(j, (F.col("content_sha256") == F.col("_d")) & (F.col("path") == F.col("_p"))).select("file_id", "id")
    return a.unionByName(b).unionByName(c).groupBy("file_id").agg(F.min("id").alias("id"))


def publish(df: DataFrame, root: str, generation: str) -> None:
    """Writes an immutable generation, then its manifest row; readers go by manifests alone."""
    df.write.mode("errorifexists").parquet(f"{root}/data/generation_id={generation}")
    digest = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).cast("string").alias("digest"))
    digest.select(F.lit(generation).alias("generation_id"), F.current_timestamp().alias("committed_at"), "n", "digest").write.mode("append").parquet(f"{root}/manifest")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed generation."""
    row = spark.read.parquet(f"{root}/manifest").orderBy(F.col("committed_at").desc(), F.col("generation_id").desc()).first()
    return spark.read.parquet(f"{root}/data/generation_id={row['generation_id']}")
