"""Exact n-gram Jaccard self-join with signature trees.

1. Every text becomes the set of 64-bit hashes of its word shingles; equal sets
   are one class from here on (key: a hash of the whole set and its size), with
   one bitmap of 2 to 4 bits a shingle.
2. Any two sets with similarity >= t share a member of their prefixes: the
   first size - ceil(t * size) + 1 members in one global order.  The order puts
   rare shingles first, by counters over all documents (a table of fixed size),
   so shared passages and licence lines stay out of the prefixes.  A member's
   place bounds the sizes of partners that first meet there.  Members that meet,
   in order of size and cut where no earlier one reaches so far, give candidate
   edges (each to the first of its run, never all pairs), whose connected
   components are the first blocks.
3. Signature trees over the bitmaps: nodes hold OR-combined bitmaps, ranges of
   size and of block; a dual traversal drops node pairs whose largest possible
   overlap is too small.  Document pairs that are left connect the documents
   into narrower blocks; only bitmaps were shipped so far.
4. The same trees again over the sets of documents in blocks of two or more,
   shipped whole; pairs that are left and not yet connected are compared exactly.

Blocks over a fixed weight are split into tiles by size class, and every pair of
tiles that can hold a link is joined; links are connected across tiles.

No link between different texts is lost: each step is exact up to collisions
of 64-bit hashes.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing; a text with fewer words than the shingle width has
its whole word sequence as its only shingle.  Rows that repeat a doc_id each
get their row; a null doc_id never becomes a component's name unless all are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, maybe_broadcast, release, ship, small, stored, text_key, without_rows

COUNTERS_LOG2 = 22  # counters of the shingle order: 2**22, whatever the input
CHUNK = 1 << 14  # counters handed on in one row
TILE_WEIGHT = 1_000_000  # shingles (plus DOC_WEIGHT a document) in one tile
DOC_WEIGHT = 500
SLICE = 256  # documents held at once by a task
FANOUT = 8
HOT = 64  # rows of one text (or a hundred-thousandth of all rows, if that is more) from which it is looked up apart

PLACE = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]  # odd factors of the words of a shingle

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_TABLE = bytes.maketrans(_UPPER, _LOWER)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes, of up to 64 words; remembers the hashes of the words it has met, up to a bound."""

    def __init__(self, width: int, held: int = 200_000) -> None:
        self.width, self.held, self.seen = width, held, {}

    def set_of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > self.held:
            seen.clear()
        try:
            h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = self.width if len(h) >= self.width else len(h)
        size = len(h) - n + 1
        out = h[:size] * np.uint64(2 * n + 1)
        for k in range(1, n):
            out += h[k : size + k] * PLACE[k]
        out = np.sort(_mix(out))
        first = np.empty(size, bool)
        first[0] = True
        np.not_equal(out[1:], out[:-1], out=first[1:])
        return out[first]


def key_of(members: np.ndarray) -> int:
    return np.int64(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).astype(np.int64)) if len(members) else 0


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n members: a power of two, at least twice n."""
    return 1 << max(6, (2 * n - 1).bit_length())


def bitmap_of(members: np.ndarray, bits: int) -> np.ndarray:
    row = np.zeros(bits, bool)
    row[(members & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little")


def folded(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of ``bits`` bits that the same set has."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, bits // 8), axis=0)


def reaches(n: int, percent: int) -> np.ndarray:
    """For each place in the order of n members: the largest size of a set that can be linked if that member is the first both share.

    Places from which no set that is large enough can be reached are left out.
    """
    most = (100 + percent) * (n - np.arange(n, dtype=np.int64)) // percent - n
    return most[: np.searchsorted(-most, -(-(-percent * n // 100)), side="right")]


def _first_pass(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, t1, t2, key, n) for each document, with a bitmap where the task meets the key first; then the task's counters in chunks."""
    s = Shingler(width)
    counts = np.zeros(1 << COUNTERS_LOG2, np.uint32)
    shift = np.uint64(64 - COUNTERS_LOG2)
    names = ["doc_id", "t1", "t2", "key", "n", "bitmap", "chunk", "counts"]
    met: set[int] = set()
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            b = batch.slice(k, SLICE)
            keys, sizes, bitmaps = [], [], []
            for t in b.column(1).to_pylist():
                m = s.set_of(t)
                at = (m >> shift).astype(np.int64)
                counts[at] = counts[at] + 1  # members of one counter count once a document
                key = key_of(m) if len(m) else None
                bitmaps.append(bitmap_of(m, width_of(len(m))).tobytes() if len(m) and key not in met else None)
                met.add(key)
                keys.append(key)
                sizes.append(len(m))
            nulls = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), b.column(3), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary()), nulls.cast(pa.int32()), nulls.cast(pa.binary())], names=names)
    one = pa.nulls(1)
    for k in range(0, len(counts), CHUNK):
        part = counts[k : k + CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([one.cast(pa.int64()), one.cast(pa.int64()), one.cast(pa.int32()), one.cast(pa.int64()), one.cast(pa.int64()), one.cast(pa.binary()), pa.array([k // CHUNK], pa.int32()), pa.array([zlib.compress(np.minimum(part, 65535).astype("<u2").tobytes(), 1)], pa.binary())], names=names)


def _add_counters(group: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint64)
    for c in group.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(c), "<u2")
    return pa.table({"chunk": group.column("chunk").slice(0, 1), "counts": pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())})


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, counts) -> Iterator[pa.RecordBatch]:
    """(shingle, n, reach, key) for every member of every prefix, once a task for each key."""
    s, order = Shingler(width), np.frombuffer(counts.value, "<u2")
    shift = np.uint64(64 - COUNTERS_LOG2)
    met: set[int] = set()
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            shingles, reach, sizes, keys = [], [], [], []
            for t in batch.column(0).slice(k, SLICE).to_pylist():
                m = s.set_of(t)
                if not len(m) or (key := int(key_of(m))) in met:
                    continue
                met.add(key)
                far = reaches(len(m), percent)
                shingles.append(m[np.argsort(order[m >> shift], kind="stable")[: len(far)]])
                reach.append(far)
                sizes.append(np.full(len(far), len(m), np.int32))
                keys.append(np.full(len(far), key, np.int64))
            if shingles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(reach).astype(np.int32)), pa.array(np.concatenate(keys))], names=["shingle", "n", "reach", "key"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    s = Shingler(width)
    met: set[int] = set()
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            got = {int(key_of(m)): m for t in batch.column(0).slice(k, SLICE).to_pylist() if len(m := s.set_of(t))}
            got = {key: m for key, m in got.items() if key not in met}
            met.update(got)
            if got:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in got.values()])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(list(got.values())).view(np.int64)))], names=["key", "members"])


# ---------------------------------------------------------------- signature trees


class Links:
    """Union-find over the documents of a block."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def labels(self) -> np.ndarray:
        up = self.up
        while True:
            two = up[up]
            if (two == up).all():
                return up
            up = self.up = two


def size_class(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Sets that can be linked are of the same class or of neighbouring ones."""
    return np.floor(np.log(sizes) / math.log(100 / percent) + 1e-9).astype(np.int64)


class SignatureTree:
    """Levels of nodes over documents of two neighbouring size classes, in order of block; level 0 are the documents.

    A node has the OR of its documents' bitmaps, their ranges of size and of block, the
    smallest class, and the most members of a document that share a bit with another one.
    """

    def __init__(self, sets: list[np.ndarray] | None = None, bitmaps: np.ndarray | None = None, sizes: np.ndarray | None = None, blocks: np.ndarray | None = None, classes: np.ndarray | None = None) -> None:
        """Of ``sets``, which are then one block of one class, or of what is given of them instead."""
        if sets is not None:
            sizes = np.array([len(m) for m in sets], np.int64)
            bitmaps = np.stack([bitmap_of(m, width_of(int(sizes.max()))) for m in sets])
            blocks = classes = np.zeros(len(sets), np.int64)
        sig = bitmaps.view(np.uint64)
        excess = sizes - np.bitwise_count(sig).sum(1).astype(np.int64)
        self.first = int(classes.min())
        self.levels = [(sig, sizes, sizes, excess, blocks, blocks, classes)]
        while len(self.levels[-1][0]) > 1:
            sig, low, high, excess, from_, to, cls = self.levels[-1]
            at = np.arange(0, len(sig), FANOUT)
            lowest, highest = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((np.bitwise_or.reduceat(sig, at), lowest(low, at), highest(high, at), highest(excess, at), lowest(from_, at), highest(to, at), lowest(cls, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether some document under node a and some under node b can reach the similarity.

        Pairs within the second class belong to the next tree.
        """
        sig, low, high, excess, from_, to, cls = self.levels[level]
        out = (from_[a] <= to[b]) & (from_[b] <= to[a]) & (percent * low[a] <= 100 * high[b]) & (percent * low[b] <= 100 * high[a]) & (np.minimum(cls[a], cls[b]) == self.first)
        at = np.flatnonzero(out)
        shared = np.zeros(len(at), np.int64)
        step = max(1, (1 << 19) // sig.shape[1])
        for k in range(0, len(at), step):
            x, y = a[at[k : k + step]], b[at[k : k + step]]
            shared[k : k + step] = np.bitwise_count(sig[x] & sig[y]).sum(1)
        a, b = a[at], b[at]
        most = np.minimum(shared + np.minimum(excess[a], excess[b]), np.minimum(high[a], high[b]))
        # similarity t needs an overlap of t / (1 + t) of both sizes together
        out[at] = (100 + percent) * most >= percent * (low[a] + low[b])
        return out

    def candidates(self, percent: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of document pairs (i < j) that the dual traversal leaves."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                yield a, b
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(FANOUT)
            x = (a[:, None, None] * FANOUT + step[None, :, None]) + 0 * step[None, None, :]
            y = (b[:, None, None] * FANOUT + step[None, None, :]) + 0 * step[None, :, None]
            x, y = x.ravel(), y.ravel()
            ok = (x < below) & (y < below) & (x <= y if level > 1 else x < y)
            x, y = x[ok], y[ok]
            ok = self.possible(level - 1, x, y, percent)
            x, y = x[ok], y[ok]
            near = np.argsort(y - x, kind="stable")[::-1]  # close ones on top of the stack
            x, y = x[near], y[near]
            for k in range(0, len(x), chunk // FANOUT):
                stack.append((level - 1, x[k : k + chunk // FANOUT], y[k : k + chunk // FANOUT]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def forest(bitmaps: list[np.ndarray], sizes: np.ndarray, blocks: np.ndarray, side: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked documents of each block; without ``sets``, all that the bitmaps leave possible.

    side: 0 or 1 where only pairs of different sides count, -1 everywhere else.
    """
    classes = size_class(sizes, percent)
    links, found = Links(len(sizes)), []
    for cls in np.unique(classes):
        at = np.flatnonzero((classes == cls) | (classes == cls + 1))
        if len(at) < 2:
            continue
        at = at[np.lexsort((sizes[at], blocks[at]))]
        bits = width_of(int(sizes[at].min()))
        tree = SignatureTree(None, np.stack([folded(bitmaps[i], bits) for i in at]), sizes[at], blocks[at], classes[at])
        for a, b in tree.candidates(percent):
            a, b = at[a], at[b]
            ok = (blocks[a] == blocks[b]) & ((side[a] != side[b]) | (side[a] < 0))
            a, b = a[ok], b[ok]
            for k in range(0, len(a), 2048):
                x, y = a[k : k + 2048], b[k : k + 2048]
                label = links.labels()
                apart = label[x] != label[y]
                for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                    r, s = links.find(i), links.find(j)
                    if r != s and (sets is None or similar(sets[i], sets[j], percent)):
                        links.up[max(r, s)] = min(r, s)
                        found.append((i, j))
    return found


def _join_block(group: pa.Table, percent: int) -> pa.Table:
    """(a, b, tiled): links of a tile, or of whole blocks, where every b is the smallest key of what it is connected with."""
    keys, side = group.column("key").to_numpy(), group.column("side").to_numpy()
    blocks = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
    sizes = group.column("n").to_numpy().astype(np.int64)
    sets = None
    if "members" in group.column_names:
        members = group.column("members").combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        flat, off = members.values.to_numpy().view(np.uint64), members.offsets.to_numpy()
        sets = [flat[off[i] : off[i + 1]] for i in range(len(keys))]
        bitmaps = [bitmap_of(m, width_of(len(m))) for m in sets]
    else:
        bitmaps = [np.frombuffer(x, np.uint8) for x in group.column("bitmap").to_pylist()]
    found = forest(bitmaps, sizes, blocks, side, percent, sets)
    tiled = bool((side >= 0).any() or group.column("tiled").to_numpy(zero_copy_only=False).any())
    if not tiled:
        links = Links(len(keys))
        low = keys.copy()
        for i, j in found:
            r, s = links.find(i), links.find(j)
            if r != s:
                links.up[r] = s
                low[s] = min(low[r], low[s])
        top = [links.find(i) for i in range(len(keys))]
        pairs = [(keys[i], low[t]) for i, t in enumerate(top) if keys[i] != low[t]]
    else:
        pairs = [(keys[i], keys[j]) for i, j in found]
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "tiled": pa.array([tiled] * len(pairs), pa.bool_())})


# ---------------------------------------------------------------- the join


def _blocks(labels: DataFrame, sizes: DataFrame, percent: int, weight: int) -> DataFrame:
    """(key, n, root, block, side, tiled): the tiles that every candidate takes part in; a tile takes ``weight`` shingles."""
    base = stored(labels.join(sizes, labels["node"] == sizes["key"]).select("key", "root", "n", (F.col("n") + DOC_WEIGHT).alias("w")), "labels")
    step = math.log(100 / percent)
    comps = stored(base.groupBy("root").agg(F.sum("w").alias("weight")), "blocks")
    light_weight, heavy_rows = comps.agg(F.coalesce(F.sum(F.when(F.col("weight") <= weight // 4, F.col("weight"))), F.lit(0)), F.count_if(F.col("weight") > weight // 4)).first()
    packs = max(1, -(-light_weight // weight))
    pack = F.concat(F.lit("p"), F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string"))
    if not heavy_rows:
        return base.select("key", "n", "root", pack.alias("block"), F.lit(-1).alias("side"), F.lit(False).alias("tiled"))
    big = comps.where(F.col("weight") > weight // 4).select(F.col("root").alias("r0"))  # at most the corpus' weight over that of a quarter tile
    all_of = base.join(maybe_broadcast(big), F.col("root") == F.col("r0"), "left")
    packed = all_of.where("r0 is null").select("key", "n", "root", pack.alias("block"), F.lit(-1).alias("side"), F.lit(False).alias("tiled"))
    heavy = all_of.where("r0 is not null").drop("r0").withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
    bins = heavy.groupBy("root", "cls").agg(F.ceil(F.sum("w") / F.lit(weight / 2)).cast("int").alias("bins"))
    bins = stored(bins, "bins")
    for d in (-1, 0, 1):
        near = bins.select(F.col("root").alias("r0"), (F.col("cls") + d).alias("c0"), F.col("bins").alias(f"bins{d + 1}"))
        heavy = heavy.join(maybe_broadcast(near), (F.col("root") == F.col("r0")) & (F.col("cls") == F.col("c0")), "left").drop("r0", "c0")
    # bins0: of the class above, bins1: of the own class, bins2: of the class below
    heavy = heavy.withColumn("own", F.pmod(F.xxhash64("key"), F.col("bins1")).cast("int"))

    def partners(bins_col: str, d: int):
        other = F.transform(F.sequence(F.lit(0), F.col(bins_col) - 1), lambda s: F.struct((F.col("cls") + d).alias("cls"), s.alias("sub")))
        return F.coalesce(F.when(F.col(bins_col) > 0, other), F.array().cast("array<struct<cls:bigint,sub:int>>"))

    near = F.concat(partners("bins0", 1), partners("bins1", 0), partners("bins2", -1))
    heavy = heavy.withColumn("mine", F.struct(F.col("cls").alias("cls"), F.col("own").alias("sub"))).select("key", "n", "root", "mine", F.explode(near).alias("other"))
    tiles = heavy.select(
        "key", "n", "root",
        F.concat_ws(":", F.lit("t"), "root", F.least("mine", "other")["cls"], F.least("mine", "other")["sub"], F.greatest("mine", "other")["cls"], F.greatest("mine", "other")["sub"]).alias("block"),
        F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        F.lit(True).alias("tiled"),
    )
    release(heavy.sparkSession)
    return packed.unionByName(tiles)


def _connected(blocks: DataFrame, content: DataFrame, percent: int, label: str) -> DataFrame:
    """(node, root) of what the trees connect in ``blocks``; ``content``: key and bitmap, or key and members."""
    what = content.columns[1]
    side = F.broadcast(blocks) if small(blocks, 300_000) else blocks
    joined = content.join(side, "key").select("block", "root", "side", "tiled", "n", "key", what)
    links = stored(joined.groupBy("block").applyInArrow(lambda g: _join_block(g, percent), "a long, b long, tiled boolean"), label)
    whole = links.where("not tiled").select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = whole.unionByName(whole.select(F.col("root").alias("node"), "root").distinct())
    tiled = links.where("tiled").select("a", "b")
    return out if tiled.isEmpty() else out.unionByName(connected_components(tiled))


def components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return _components(docs, width, percent, id_col, text_col).drop("t1", "t2")


def _counters(first: DataFrame) -> bytes:
    total = np.zeros(1 << COUNTERS_LOG2, "<u2")
    summed = first.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(_add_counters, "chunk int, counts binary")
    for chunk, counts in summed.toLocalIterator():  # 2**23 bytes in all, whatever the input
        total[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, "<u2")
    return total.tobytes()


def _candidates(texts: DataFrame, width: int, percent: int, held) -> DataFrame:
    """(a, b): each set that meets others, and the first of its run."""
    met = texts.mapInArrow(lambda it: _prefixes(it, width, percent, held), "shingle long, n int, reach int, key long")
    order = Window.partitionBy("shingle").orderBy("n", "key")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = met.withColumn("first", F.when(before.isNull() | (before < F.col("n")), F.col("key")))
    runs = runs.withColumn("low", F.last("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))


def _components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1 and t2 (the text's key), n_shingles, component_id of every document."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", "text", *text_key(F.col("text")))
    one = "doc_id long, t1 long, t2 int, key long, n long, bitmap binary, chunk int, counts binary"
    first = stored(docs.mapInArrow(lambda it: _first_pass(it, width), one), "jaccard")
    known = first.where("chunk is null").select("doc_id", "t1", "t2", "key", "n")

    # one row for each distinct set, with the row that stands for it and the number of rows
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2"))
    classes = known.where("key is not null").groupBy("key").agg(rep.alias("rep"), F.first("n").cast("int").alias("n"), F.count("*").alias("copies"))
    classes = stored(classes.select("key", "n", "copies", "rep.doc_id", "rep.t1", "rep.t2"), "classes")
    rows = known.count()
    hot = max(HOT, rows // 100_000)
    often = classes.where(F.col("copies") > hot)  # at most 100,000 rows
    hot_rows = F.broadcast(often.select(F.col("t1").alias("h1"), F.col("t2").alias("h2"), F.col("doc_id").alias("h0")))
    texts = docs.join(hot_rows, (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")), "left").where(F.col("h1").isNull() | F.col("doc_id").eqNullSafe(F.col("h0"))).select("text")

    held = spark.sparkContext.broadcast(_counters(first))
    labels = connected_components(_candidates(texts, width, percent, held))
    held.unpersist()
    release(spark)

    sizes = classes.select("key", "n")
    bitmaps = first.where("bitmap is not null").select("key", "bitmap").dropDuplicates(["key"])
    labels = _connected(_blocks(labels, sizes, percent, 4 * TILE_WEIGHT), bitmaps, percent, "possible")
    wanted = stored(labels.join(classes, labels["node"] == classes["key"]).select("node", "root", "n", "doc_id", "t1", "t2"), "wanted")
    release(spark)
    blocks = _blocks(wanted.select("node", "root"), wanted.select(F.col("node").alias("key"), "n"), percent, TILE_WEIGHT)
    ids = wanted.select(F.col("doc_id").alias("w0"), F.col("t1").alias("w1"), F.col("t2").alias("w2"))
    chosen = docs.join(maybe_broadcast(ids), (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w0")), "left_semi").select("text")
    sets = chosen.mapInArrow(lambda it: _sets(it, width), "key long, members array<long>")
    final = _connected(blocks, sets, percent, "links")
    release(spark)

    named = final.join(classes.select(F.col("key").alias("node"), "doc_id"), "node").select("node", "root", "doc_id")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("low"))
    named = named.join(maybe_broadcast(lowest), "root").select(F.col("node").alias("key"), "low")
    # only sets of several rows or with links have to be looked up; those of very many rows apart, so that none gathers them
    lookup = classes.join(maybe_broadcast(named), "key", "left").where("copies > 1 or low is not null")
    lookup = stored(lookup.select("key", "copies", F.coalesce("low", "doc_id").alias("low")), "named")
    at_hot = F.broadcast(lookup.where(F.col("copies") > hot).select("key", F.col("low").alias("hot_low")))
    rest = lookup.where(F.col("copies") <= hot).select("key", "low")
    near = known.join(at_hot, "key", "left")
    alone = near.where("key is null or hot_low is not null").withColumn("low", F.lit(None).cast("long"))
    out = alone.unionByName(near.where("key is not null and hot_low is null").join(maybe_broadcast(rest), "key", "left"))
    return out.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), F.coalesce("hot_low", "low", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest doc_id (rows of the component repeating it stay)."""
    rows = _components(docs, id_col=id_col, text_col=text_col, **options)
    gone = rows.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "t1", "t2")
    return without_rows(docs, gone, [docs[id_col].cast("long"), *text_key(docs[text_col].cast("string"))])
