"""Secret scans by compression novelty.

Three base patterns give the spans of assignments, access keys and hex strings.
Beside them, every string of key characters near a sensitive word, or in a run of
strings with one that is (the lines of a key, the parts of a token), is measured:
the bytes it adds when zstandard compresses the code around it, primed with a
dictionary of common identifiers, with and without the string.  Strings that
add nearly as many bytes as they have are reported as spans of kind ``novel``.

Defined results: a null or empty text has no spans; spans are in code points,
end exclusive, ordered by start, then kind (assign, access, hex, novel).
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex", "novel")
AROUND = 160  # characters on either side that a candidate is measured against
REACH = 48  # characters between a candidate and a sensitive word on either side of it
RATE = 0.72  # marginal bytes a character of a reported string (random base64 needs .75, words under .5)
LEAST = 16  # characters of a candidate

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_SENSITIVE = re.compile(r"passw(?:or)?d|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|client[_ -]?id", re.I | re.A)
_HINTS = ("passw", "pwd", "secret", "token", "api", "access", "private", "credential", "bearer", "authorization", "client")
_STRING = re.compile(r"[A-Za-z0-9+/_=-]+")
_JOINT = re.compile(r"[\s.\"'`\\,+]*")
_BEFORE = re.compile(r"(?:^|[\r\n])[\s\"'`]*\Z")
_AFTER = re.compile(r"[\x20\t\"'`\\,]*(?:[\r\n]|\Z|(?<=\\)[nr])")

#: Identifiers and phrases that are common around secrets in code; part of the dictionary, not of the patterns.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret authorization bearer "
    "credential credentials username user_name connection_string database_url environment variable config configuration "
    "export const let var string return function class public private static final import from include require module "
    "request response header headers content_type application json charset utf-8 localhost example http https www com org "
    "access_token refresh_token session_id user_id account_id project_id region bucket endpoint version default production "
    "development staging testing test sample placeholder changeme your_password_here your_api_key_here insert_token_here "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000"
)


class Novelty:
    def __init__(self, identifiers: str = IDENTIFIERS) -> None:
        self.dict = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=19, dict_data=self.dict, write_content_size=False, write_checksum=False)

    def bytes_of(self, text: str, start: int, end: int) -> int:
        """Marginal compressed bytes of text[start:end] against the code around it."""
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        size = lambda s: len(self.zip.compress(s.encode("utf-8", "surrogatepass")))
        return size(before + after + text[start:end]) - size(before + after)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, index in KINDS, end) of the three base patterns."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] has a line to itself, apart from quotes and the like; line ends may be escaped."""
    first = _BEFORE.search(text, max(0, start - AROUND), start) or text[start - 1 : start] == "\\" and text[start] in "nr"
    return bool(first and _AFTER.match(text, end))


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of candidates: those of a run are apart by line ends, dots, quotes and the like only.

    Strings shorter than LEAST count only as lines of their own right after a candidate that is one too.
    """
    run: list[tuple[int, int]] = []
    for c in _STRING.finditer(text):
        s, e = c.span()
        apart = bool(run) and not _JOINT.fullmatch(text, run[-1][1], s)
        if e - s < LEAST and (not run or apart or not (_alone(text, *run[-1]) and _alone(text, s, e))):
            continue
        if apart:
            yield run
            run = []
        run.append((s, e))
    if run:
        yield run


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what base spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Strings near sensitive words, or in a run with one that is, that hardly compress, apart from the base spans.

    A string counts if it is novel by itself, if its run is as a whole, or from the first sensitive word in it on.
    Of a string that base spans cover in part, the parts between them are looked at; one shorter than LEAST
    counts if it goes on with letters and digits where a span of kind access or hex ends or begins.
    """
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    from_, to = _merged(base)
    keys = {x for s, k, e in base if k in (1, 2) for x in (s, e)}
    near = lambda s, e: (k := bisect.bisect_left(ends, s - REACH)) < len(words) and starts[k] <= e + REACH

    def free(s: int, e: int) -> list[tuple[int, int]]:
        """The parts of a string outside base spans."""
        k, at, parts = bisect.bisect_right(to, s), s, []
        while k < len(from_) and from_[k] < e:
            if from_[k] > at:
                parts.append((at, from_[k]))
            at = to[k]
            k += 1
        return [*parts, (at, e)] if at < e else parts

    out = []
    for run in _runs(text):
        if not any(near(s, e) for s, e in run):
            continue
        bytes_of: dict[tuple[int, int], int] = {}
        for s, e in run:
            parts = free(s, e)
            for part in parts:
                if part == (s, e) or part[1] - part[0] >= LEAST:
                    bytes_of[part] = novelty.bytes_of(text, *part)
                elif keys.intersection(part) and text[part[0] : part[1]].isalnum():
                    out.append((part[0], 3, part[1]))
        whole = sum(bytes_of.values()) >= RATE * sum(e - s for s, e in bytes_of)
        for s, e in bytes_of:
            if whole or bytes_of[s, e] >= RATE * (e - s):
                out.append((s, 3, e))
                continue
            k = bisect.bisect_left(starts, s)
            if k < len(starts) and s < (at := starts[k]) <= e - LEAST and novelty.bytes_of(text, at, e) >= RATE * (e - at):
                out.append((at, 3, e))
    return out


def spans_of(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[{kind}]") -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], mark.format(kind=KINDS[k])]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            b = batch.slice(k, 256)
            found = [spans_of(t, novelty) for t in b.column(1).to_pylist()]
            count = [pa.array([sum(x[1] == kind for x in f) for f in found], pa.int64()) for kind in range(3)]
            digest = [hashlib.sha256(joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *count, pa.array(digest, pa.string()), pa.array([joined(f) for f in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text."""
    ship(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    novelty = Novelty()
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            b = batch.slice(k, 256)
            text = [t if t is None else redacted(t, spans_of(t, novelty)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with secrets in ``text`` replaced and n_chars counted anew where it was the text's length."""
    ship(documents.sparkSession)
    at = documents.columns.index("text")
    n = "n_chars" in documents.columns
    rows = documents.withColumn("_same", F.col("n_chars") == F.length("text")) if n else documents
    out = rows.mapInArrow(lambda it: _redact(it, at), rows.schema)
    if n:
        out = out.withColumn("n_chars", F.when(F.col("_same"), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).drop("_same")
    return out
