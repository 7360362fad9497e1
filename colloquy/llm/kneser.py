"""Scores under an interpolated modified Kneser-Ney n-gram model.

Words are 64-bit hashes; the training words' sorted hashes number them, and a gram is
the pair of what it is without its last and without its first word.  Tasks count their
own grams, send each shard of them one block of arrays, and a shard adds up equal
grams, writes its sorted keys with counts to the shared folder, and hands on, for the
grams one word shorter, how many words each follows and, as a history, its total and how many
words follow it once, twice and more often.  Nothing is pruned or sampled.  Workers
memory-map the sorted arrays and look up the distinct grams of a few documents at a
time, in order of key.

The model: discounts D1, D2, D3+ of each length from its counts of counts; the
longest grams, and those at the start of a text, have raw counts, others the number of
words they follow; each length is interpolated with the next shorter one, single words
with the uniform distribution over the training words and one unknown word.

Tokens are the words between spaces (0x20, 0x09 to 0x0D), A-Z in lower case, then one
end of text.  Defined results: a null text is empty, and has the end alone; without training
texts every token has probability 1.  Counts are exact up to collisions of 64-bit hashes
(for grams of up to two words: of words alone).  A shard that is written again, by a
task that replaces a lost one, has the same content and takes the old one's place at
once.  Up to 2^32 - 2 distinct training words.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, ship, stored

CHUNK = 1_000_000  # tokens counted or scored together, unless one text has more
ROWS = 64  # texts taken out of a batch together
WORD_BYTES, GRAM_BYTES = 32 << 20, 8 << 20  # of training text for each shard of words, of grams
IDS = 1 << 18  # words in a shard of histories, at most
SPREAD = 64  # groups that counts of counts meet in
HELD_BYTES = 256 << 20  # of shards that a worker holds where the shared folder can't be mapped

END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end
STATS = ("follows", "total", "once", "twice", "more")
BLOCKS = "shard long, kind int, block binary"


# ---------------------------------------------------------------- files


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One uncompressed Arrow file, in place at once and whole."""
    fs, path = _at(uri)
    fs.create_dir(os.path.dirname(path))
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f, pa.ipc.new_file(f, batch.schema) as w:
        w.write_batch(batch)
    fs.move(part, path)


class Files:
    """Arrays of a model's files, mapped; where the folder isn't in a mounted file system, the last read ones in memory."""

    def __init__(self) -> None:
        self.held: dict[str, dict[str, np.ndarray]] = {}
        self.bytes = 0

    def read(self, uri: str) -> dict[str, np.ndarray]:
        if uri not in self.held:
            fs, path = _at(uri)
            local = isinstance(fs, pafs.LocalFileSystem)
            with pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path)) as f:
                batch = f.get_batch(0)
            if not local:
                if self.bytes > HELD_BYTES:
                    self.held, self.bytes = {}, 0
                self.bytes += batch.nbytes
            self.held[uri] = {n: c.to_numpy() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        return self.held[uri]


def _least(a: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)


# ---------------------------------------------------------------- keys


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(k: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of grams of k words from those of their first and last k - 1 words; exact for k = 2, hashes beyond."""
    left, right = left.astype(np.uint64), right.astype(np.uint64)
    return mixed((left << np.uint64(32)) | right) if k == 2 else mixed(mixed(left) + right + np.uint64(k))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys of equal width."""
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of an ascending array."""
    at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    for a, b in zip(at, np.r_[at[1:], len(shard)], strict=True):
        yield int(shard[a]), slice(int(a), int(b))


def _block(shard: int, kind: int, *arrays: np.ndarray) -> tuple[int, int, bytes]:
    return shard, kind, b"".join([np.array([len(arrays[0])], "<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unblock(block: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(block, "<i8", 1)[0]), 8, []
    for k in kinds:
        out.append(np.frombuffer(block, k, n, at))
        at += out[-1].nbytes
    return out


def _batch(blocks: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, block = zip(*blocks, strict=True) if blocks else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(kind, pa.int32()), pa.array(block, pa.binary())], names=["shard", "kind", "block"])


# ---------------------------------------------------------------- texts


@dataclass
class Chunk:
    """Whole texts, each ended: their distinct words' hashes, the number among those of every token, and where texts start."""

    ids: list
    words: np.ndarray
    token: np.ndarray
    start: np.ndarray


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Batches of (id, text in UTF-8) as chunks."""
    ids, sizes, tokens, known = [], [], [], defaultdict(count().__next__)

    def out() -> Chunk:
        words = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        end = np.cumsum(np.array(sizes, np.int64))
        got = Chunk(list(ids), words, np.concatenate(tokens), end - sizes)
        for x in (ids, sizes, tokens, known):
            x.clear()
        known.default_factory = count().__next__
        return got

    held = 0
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            some = b.slice(k, ROWS)
            for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                # bytes: lower() changes A-Z only, split() cuts at 0x20 and 0x09 to 0x0D only
                split = text.lower().split() if text else []
                split.append(b"\n")
                tokens.append(np.fromiter(map(known.__getitem__, split), np.int32, len(split)))
                ids.append(i)
                sizes.append(len(split))
                held += len(split)
                if held >= CHUNK:
                    yield out()
                    held = 0
    if ids:
        yield out()


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    path: str
    order: int
    word_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # number of the first word of each shard, and of all words
    tokens: int = 0
    gram_shards: int = 1
    discounts: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    total: int = 0  # of the counts of single words
    left_over: float = 1.0  # what their discounts leave

    @property
    def words(self) -> int:
        return int(self.word_at[-1])

    @property
    def begin(self) -> int:
        return self.words

    @property
    def ids(self) -> int:
        """Words in a shard of histories: more of those shards for more grams, so that what each is told stays the same."""
        return min(IDS, 2 * (self.words + 1) // self.gram_shards + 1)

    def word_uri(self, shard: int) -> str:
        return f"{self.path}/words/{shard}.arrow"

    def gram_uri(self, k: int, shard: int) -> str:
        return f"{self.path}/grams{k}/{shard}.arrow"


class Reader:
    """Look-ups in a model's files; queries are distinct keys in ascending order."""

    def __init__(self, model: Model) -> None:
        self.model, self.files = model, Files()

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and raw counts of words' hashes, in any order."""
        at = self.model.word_at
        order = np.argsort(hashes)
        ids, raw = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s, cut in _cuts(shard_of(hashes[order], len(at) - 1)):
            if at[s + 1] > at[s]:
                held, o = self.files.read(self.model.word_uri(s)), order[cut]
                place = np.minimum(np.searchsorted(held["key"], hashes[o]), len(held["key"]) - 1)
                hit = held["key"][place] == hashes[o]
                ids[o[hit]], raw[o[hit]] = at[s] + place[hit], held["count"][place[hit]]
        return ids, raw

    def grams(self, k: int, keys: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """What the files of grams of k words say; 0 where there is no such gram."""
        out = [np.zeros(len(keys), np.int64) for _ in names]
        for s, cut in _cuts(shard_of(keys, self.model.gram_shards)):
            held = self.files.read(self.model.gram_uri(k, s))
            if len(held["key"]):
                place = np.minimum(np.searchsorted(held["key"], keys[cut]), len(held["key"]) - 1)
                hit = held["key"][place] == keys[cut]
                for o, n in zip(out, names, strict=True):
                    o[cut] = np.where(hit, held[n][place], 0)
        return out

    def singles(self, ids: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        out = [np.zeros(len(ids), np.int64) for _ in names]
        for s, cut in _cuts(ids // self.model.ids):
            held = self.files.read(self.model.gram_uri(1, s))
            for o, n in zip(out, names, strict=True):
                o[cut] = held[n][ids[cut] - s * self.model.ids]
        return out

    def discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        return c - np.array([0.0, *self.model.discounts[k]])[np.minimum(c, 3)]

    def single(self, ids: np.ndarray) -> np.ndarray:
        """Probability of words (distinct, ascending; -1: unknown)."""
        m = self.model
        if not m.total:
            return np.ones(len(ids))
        known = ids >= 0
        c = np.zeros(len(ids), np.int64)
        (c[known],) = self.singles(ids[known], ("follows",))
        return self.discounted(1, c) / m.total + m.left_over / (m.words + 1)

    def probabilities(self, seq: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of every token of texts that begin with the mark of their start (1 for that), given those before it; ``place`` counts within a text."""
        m = self.model
        one, at = np.unique(seq, return_inverse=True)
        p = np.where(place > 0, self.single(one)[at], 1.0)
        for k, left, right, fine, asked in spans(m.order if m.total else 1, seq, place):
            # histories that have followers, and what follows them
            past, at = np.unique(left[asked], return_inverse=True)
            total, once, twice, more = (x[at] for x in (self.singles(past, STATS[1:]) if k == 2 else self.grams(k - 1, past, STATS[1:])))
            keys, back = np.unique(joined(k, left[fine], right[fine]), return_inverse=True)
            c = np.zeros(len(seq), np.int64)
            c[fine] = self.grams(k, keys, ("count",))[0][back]
            some, met = total > 0, np.flatnonzero(asked)[total > 0]
            d = m.discounts[k]
            left_over = (d[0] * once + d[1] * twice + d[2] * more)[some] / total[some]
            p[met] = self.discounted(k, c[met]) / total[some] + left_over * p[met]
        return p


def spans(order: int, seq: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 2, 3, ...: k, the keys of the gram of k - 1 words before each token and of that which ends in it, where both are known words, and where the first is."""
    key, known = seq, seq >= 0
    for k in range(2, order + 1):
        left = np.r_[key[:1], key[:-1]]
        asked = np.r_[False, known[:-1]] & (place >= k - 1)
        fine = asked & known
        yield k, left, key, fine, asked
        if k < order:
            longer = np.zeros(len(seq), np.uint64)
            longer[fine] = joined(k, left[fine], key[fine])
            key, known = longer, fine


def begun(chunk: Chunk, ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's tokens by number, a mark before each text, and each one's place in its text."""
    seq = np.insert(ids[chunk.token], chunk.start, begin)
    start = chunk.start + np.arange(len(chunk.start))
    return seq, np.arange(len(seq)) - np.repeat(start, np.diff(np.r_[start, len(seq)]))


# ---------------------------------------------------------------- learning


def _sums(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys, the columns' sums, and where each key is first."""
    one, first, at = np.unique(key, return_index=True, return_inverse=True)
    out = []
    for c in columns:
        s = np.zeros(len(one), np.int64)
        np.add.at(s, at, c.astype(np.int64))
        out.append(s)
    return one, out, first


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        order = np.argsort(c.words)
        key, n = c.words[order], np.bincount(c.token, minlength=len(c.words))[order].astype("<i8")
        yield _batch([_block(s, 0, key[cut], n[cut]) for s, cut in _cuts(shard_of(key, shards))])


def _add_words(rows: pa.Table, model: Model) -> pa.Table:
    shard = rows.column("shard")[0].as_py()
    key, n = (np.concatenate(x) for x in zip(*(_unblock(b, ("<u8", "<i8")) for b in rows.column("block").to_pylist()), strict=True))
    key, (n,), _ = _sums(key, n)
    _write(model.word_uri(shard), {"key": key, "count": _least(n)})
    return pa.table({"shard": pa.array([shard], pa.int64()), "words": pa.array([len(key)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})


def _count_grams(batches: Iterator[pa.RecordBatch], model: Model, k: int) -> Iterator[pa.RecordBatch]:
    kind = "<u4" if k == 2 else "<u8"
    reader = Reader(model)
    for c in chunks(batches):
        seq, place = begun(c, reader.word_ids(c.words)[0], model.begin)
        _, left, right, fine, _ = next(x for x in spans(k, seq, place) if x[0] == k)
        left, right, first = left[fine], right[fine], (place == k - 1)[fine]
        key, (n,), at = _sums(joined(k, left, right), np.ones(len(left), np.int64))
        left, right, first = left[at].astype(kind), right[at].astype(kind), first[at].astype("u1")
        yield _batch([_block(s, 0, left[cut], right[cut], n[cut].astype("<u4"), first[cut]) for s, cut in _cuts(shard_of(key, model.gram_shards))])


def _told(level: int, shard: int, count: np.ndarray) -> tuple[int, int, bytes]:
    """Counts of counts, their sum and number, on their way to the end."""
    t = [int((count == x).sum()) for x in (1, 2, 3, 4)]
    return _block(-1 - shard % SPREAD, 2, *(np.array([x], "<i8") for x in (level, *t, int(count.sum()), len(count))))


def _add_told(blocks: list[bytes], shard: int) -> pa.Table:
    rows = np.concatenate([np.stack(_unblock(b, ("<i8",) * 7), 1) for b in blocks])
    level, sums, _ = _sums(rows[:, 0], *rows[:, 1:].T)
    return pa.Table.from_batches([_batch([_block(shard, 2, level, *sums)])])


def _add_grams(rows: pa.Table, model: Model, k: int) -> pa.Table:
    """A shard of grams of k words, written; what it says of the grams of k - 1."""
    shard, kinds, blocks = rows.column("shard")[0].as_py(), rows.column("kind").to_pylist(), rows.column("block").to_pylist()
    if shard < 0:
        return _add_told(blocks, shard)
    width = "<u4" if k == 2 else "<u8"
    left, right, n, first = (np.concatenate(x) for x in zip(*(_unblock(b, (width, width, "<u4", "u1")) for b, x in zip(blocks, kinds, strict=True) if x == 0), strict=True))
    key, (n,), at = _sums(joined(k, left, right), n)
    left, right, first = left[at], right[at], first[at]
    files = {"key": key, "count": n}
    if k < model.order:
        said = [_unblock(b, ("<u8", *("<i8",) * 5)) for b, x in zip(blocks, kinds, strict=True) if x == 1]
        stats = [np.zeros(len(key), np.int64) for _ in STATS]
        for whose, *columns in said:
            place = np.searchsorted(key, whose)
            for s, c in zip(stats, columns, strict=True):
                np.add.at(s, place, c)
        files |= dict(zip(STATS, stats, strict=True))
        n = files["count"] = np.where(first > 0, n, files.pop("follows"))
    _write(model.gram_uri(k, shard), {"key": key} | {x: _least(a) for x, a in files.items() if x != "key"})
    # for the grams one shorter: each is followed here as the history, and follows another as the rest
    zero, one = np.zeros(len(key), np.int64), np.ones(len(key), np.int64)
    both = [(zero, one), (n, zero), (n == 1, zero), (n == 2, zero), (n > 2, zero)]
    whose, stats, _ = _sums(np.concatenate([left, right]).astype("<u8"), *(np.concatenate(x) for x in both))
    to = (whose // np.uint64(model.ids)).astype(np.int64) if k == 2 else shard_of(whose, model.gram_shards)
    return pa.Table.from_batches([_batch([*(_block(s, 1, whose[cut], *(x[cut] for x in stats)) for s, cut in _cuts(to)), _told(k, shard, n)])])


def _add_singles(rows: pa.Table, model: Model) -> pa.Table:
    shard, blocks = rows.column("shard")[0].as_py(), rows.column("block").to_pylist()
    if shard < 0:
        return _add_told(blocks, shard)
    stats = [np.zeros(min(model.ids, model.words + 1 - shard * model.ids), np.int64) for _ in STATS]
    for b in blocks:
        whose, *columns = _unblock(b, ("<u8", *("<i8",) * 5))
        for s, c in zip(stats, columns, strict=True):
            np.add.at(s, whose.astype(np.int64) - shard * model.ids, c)
    _write(model.gram_uri(1, shard), dict(zip(STATS, map(_least, stats), strict=True)))
    return pa.Table.from_batches([_batch([_told(1, shard, stats[0])])])


def discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts; 0.5, 1 or 1.5 where those don't give one above 0 and up to the count."""
    y = t1 / (t1 + 2 * t2) if t1 else 0.0
    out = []
    for k, (a, b) in enumerate(((t1, t2), (t2, t3), (t3, t4)), 1):
        d = k - (k + 1) * y * b / a if a and y else 0.0
        out.append(d if 0 < d <= k else k / 2)
    return tuple(out)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def _folder(spark, label: str) -> str:
    """A new folder in the shared one, as its file system names it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_dir(spark, label))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def train(texts: DataFrame, order: int = 2, text_col: str = "text") -> Model:
    """Learns from every row of ``texts``."""
    if order < 2:
        raise ValueError("grams have two words at least")
    spark = texts.sparkSession
    ship(spark)
    rows = _texts(texts.withColumn("_row", F.lit(0)), "_row", text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.count("*"))).first()[0]
    model = Model(_folder(spark, "kneser"), order, gram_shards=int(size // GRAM_BYTES) + 1)
    shards = int(size // WORD_BYTES) + 1
    counted = rows.mapInArrow(lambda it: _count_words(it, shards), BLOCKS).groupBy("shard").applyInArrow(lambda t: _add_words(t, model), "shard long, words long, tokens long")
    sizes = {r["shard"]: r for r in stored(counted, "kneser-words").collect()}  # a row for each shard
    model.word_at = np.cumsum([0, *(sizes[s]["words"] if s in sizes else 0 for s in range(shards))])
    model.tokens = sum(r["tokens"] for r in sizes.values())
    if not model.words:
        return model
    if model.words + 1 >= 2**32:
        raise ValueError("more distinct words than 32 bits number")

    def added(k: int, passed: DataFrame | None) -> DataFrame:
        grams = rows.mapInArrow(lambda it: _count_grams(it, model, k), BLOCKS)
        return (grams if passed is None else grams.unionByName(passed)).groupBy("shard").applyInArrow(lambda t: _add_grams(t, model, k), BLOCKS)

    passed = None
    for k in range(order, 1, -1):
        passed = added(k, passed)
    last = stored(passed.groupBy("shard").applyInArrow(lambda t: _add_singles(t, model), BLOCKS), "kneser-counts")
    told = np.concatenate([np.stack(_unblock(r["block"], ("<i8",) * 7), 1) for r in last.collect()])  # of SPREAD groups, and a row for each shard of words
    for level in range(1, order + 1):
        t = told[told[:, 0] == level].sum(0)
        model.discounts[level] = discounts(*map(int, t[1:5]))
        if level == 1:
            model.total, d = int(t[5]), model.discounts[1]
            model.left_over = float(d[0] * t[1] + d[1] * t[2] + d[2] * (model.words - t[1] - t[2])) / model.total
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    reader = Reader(model)
    base = np.log10(model.tokens + 0.5 * (model.words + 1))
    for c in chunks(batches):
        ids, raw = reader.word_ids(c.words)
        seq, place = begun(c, ids, model.begin)
        log_p = np.log10(reader.probabilities(seq, place))
        start = c.start + np.arange(len(c.start))
        sizes = np.diff(np.r_[c.start, len(c.token)])
        flat = np.add.reduceat((np.log10(raw + 0.5) - base)[c.token], c.start)
        known = np.add.reduceat((ids >= 0)[c.token].astype(np.int64), c.start)
        score = np.add.reduceat(log_p, start)
        for k in range(0, len(c.ids), 10_000):
            s = slice(k, k + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(c.ids[s], pa.int64()), pa.array(sizes[s], pa.int64()), pa.array(known[s], pa.int64()), pa.array(flat[s]), pa.array(score[s])], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known (of training words), train_tokens, base_score (single words, half a count added), score: log10 of the text's probability, perplexity."""
    ship(documents.sparkSession)
    rows = _texts(documents.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), id_col, text_col)
    got = rows.mapInArrow(lambda it: _score(it, model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return got.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
