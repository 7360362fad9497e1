"""Ranked lexical search by a threshold-seeded join.

Documents become rows of an index (their length, and the terms that items ask for
with their counts), written once.  For every term the index gives its weight, its
largest impact and its kth largest one.  All impacts add up and none is negative,
so the largest kth impact among an item's terms is a lower bound on its kth score
(the seed of its threshold).  An item's terms are put in order of largest possible
impact; the sum of those of a suffix bounds what a document can reach that has no
other term, and a suffix that stays below the threshold is pruned.  Documents with
a term that is left are candidates, in the task that holds their row; what they have
so far, with the bound of the pruned terms, must reach the threshold, which rises with
the task's own heaps.  Those candidates are scored exactly over all terms, and every
task hands on the k best of each item.

Items go to all tasks in blocks of at most PAIRS pairs of item and term, a size
that is counted first; each block is one pass over the index.

Defined results: a null or empty text has no terms; an item without terms, or whose
terms are in no document, has no rows.  Rows that share an item_id are one item, whose
terms are those of its distinct texts together.  Rows of ``documents`` count one by one, rows that
share a doc_id too; a null doc_id comes after all others of equal score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, ship, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WANTED = 500_000  # distinct terms that tasks get to index only those; beyond, all terms are indexed
PAIRS = 200_000  # of item and term in a block
SLICE = 1024  # documents scored together
EXPANDED = 2_000_000  # pairs of posting and item held at once, unless one document has more

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: TERM over UTF-8: every byte from 0x80 on belongs to a character from U+0080 on.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

INDEX = "doc_id long, n long, terms array<string>, counts array<long>"


def _index(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    asked = wanted.value if wanted is not None else None
    kind = pa.list_(pa.string())
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            b = batch.slice(k, SLICE)
            sizes, offsets, terms, counts = [], [0], [], []
            for text in b.column(1).to_pylist():
                found = _TERM.findall(text.lower()) if text else []  # of bytes, lower() changes A-Z only
                sizes.append(len(found))
                have = Counter(found if asked is None else filter(asked.__contains__, found))
                terms += have.keys()
                counts += have.values()
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            held = pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), held.cast(kind), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names=["doc_id", "n", "terms", "counts"])


def index(documents: DataFrame, asked: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and their counts of every row; with ``asked`` (column term) only those terms are listed, if they are few enough to be sent."""
    spark = documents.sparkSession
    ship(spark)
    wanted = None
    if asked is not None:
        got = asked.select("term").distinct().limit(WANTED + 1).toArrow().column(0)
        if len(got) <= WANTED:
            wanted = spark.sparkContext.broadcast({t.encode() for t in got.to_pylist()})
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: _index(it, wanted), INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, q: how often the item has the term."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return rows.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("q"))


def term_gains(held: DataFrame, docs: int, terms: int, k: int) -> DataFrame:
    """term, df, and the largest and the kth largest gain (an impact before its weight; 0 if fewer documents have the term) among documents."""
    post = held.select("n", F.inline(F.arrays_zip("terms", F.col("counts").alias("tf"))).alias("term", "tf"))
    gain = post.select("term", "tf", F.expr(f"75L + (25L * n * {docs}L) div {max(terms, 1)}L").alias("m")).select("term", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)").alias("gain"))
    # gains are few for each term, however many documents have it
    by = stored(gain.groupBy("term", "gain").agg(F.count("*").alias("c")), "gains")
    over = Window.partitionBy("term").orderBy(F.desc("gain")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.withColumn("above", F.sum("c").over(over))
    return ranked.groupBy("term").agg(F.sum("c").alias("df"), F.max("gain").alias("top"), F.coalesce(F.max(F.when(F.col("above") >= k, F.col("gain"))), F.lit(0).cast("long")).alias("kth"))


def seeded(asked: DataFrame, gains: DataFrame, docs: int) -> DataFrame:
    """item_id, term, weight (of one item's term, with its repeats), bound, threshold, essential: what of an item can't be pruned."""
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1)))
    rows = asked.join(maybe_broadcast(gains), "term").withColumn("weight", F.col("q") * weight)
    rows = rows.withColumn("bound", F.col("weight") * F.col("top")).where("bound > 0")
    item = Window.partitionBy("item_id")
    suffix = item.orderBy(F.desc("bound"), "term").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("threshold", F.greatest(F.max(F.col("weight") * F.col("kth")).over(item), F.lit(1).cast("long")))
    return rows.withColumn("essential", F.sum("bound").over(suffix) >= F.col("threshold")).select("item_id", "term", "weight", "bound", "threshold", "essential")


@dataclass
class Block:
    """Items and their terms by number: rows of pairs in order of term (essential ones) and of item (pruned ones)."""

    items: pa.Array
    terms: pa.Array
    threshold: np.ndarray  # of each item
    rest: np.ndarray  # bound of each item's pruned terms
    by_term: np.ndarray  # where each term's essential pairs start
    term_item: np.ndarray
    term_weight: np.ndarray
    by_item: np.ndarray  # where each item's pruned pairs start
    item_term: np.ndarray
    item_weight: np.ndarray


def _block(rows: pa.Table) -> Block:
    column = lambda name: rows.column(name).combine_chunks()
    whole = lambda name: rows.column(name).to_numpy()
    items, terms = pc.unique(column("item_id")), pc.unique(column("term"))
    item = pc.index_in(column("item_id"), items).to_numpy(zero_copy_only=False).astype(np.int64)
    term = pc.index_in(column("term"), terms).to_numpy(zero_copy_only=False).astype(np.int64)
    weight, bound, left = whole("weight"), whole("bound"), whole("essential").astype(bool)
    threshold, rest = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    threshold[item] = whole("threshold")
    np.add.at(rest, item[~left], bound[~left])
    starts = lambda x, n: np.searchsorted(x, np.arange(n + 1))
    a = np.flatnonzero(left)[np.argsort(term[left], kind="stable")]
    b = np.flatnonzero(~left)[np.argsort(item[~left], kind="stable")]
    return Block(items, terms, threshold, rest, starts(term[a], len(terms)), item[a], weight[a], starts(item[b], len(items)), term[b], weight[b])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of numbers: which range each member comes from, and the member."""
    size = end - start
    origin = np.repeat(np.arange(len(size)), size)
    return origin, np.arange(len(origin)) - np.repeat(np.cumsum(size) - size, size) + start[origin]


class Best:
    """The k best documents of each item so far: higher scores first, then smaller ids, null last."""

    def __init__(self, block: Block, k: int) -> None:
        self.k, self.threshold = k, block.threshold.copy()
        self.item, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def merge(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.doc, self.null = item[keep], score[keep], doc[keep], null[keep]
        last = rank[keep] == self.k - 1
        self.threshold[self.item[last]] = np.maximum(self.threshold[self.item[last]], self.score[last])


def score_slice(block: Block, best: Best, doc: np.ndarray, null: np.ndarray, row: np.ndarray, term: np.ndarray, gain: np.ndarray) -> None:
    """Puts documents (numbered by ``row``, their postings in order of row) into ``best``."""
    n = block.by_term[term + 1] - block.by_term[term]
    if n.sum() > EXPANDED and len(doc) > 1:  # in halves
        half = len(doc) // 2
        at = np.searchsorted(row, half)
        score_slice(block, best, doc[:half], null[:half], row[:at], term[:at], gain[:at])
        score_slice(block, best, doc[half:], null[half:], row[at:] - half, term[at:], gain[at:])
        return
    width = len(block.items)
    post, pair = _ranges(block.by_term[term], block.by_term[term + 1])
    met, at = np.unique(row[post] * width + block.term_item[pair], return_inverse=True)
    score = np.zeros(len(met), np.int64)
    np.add.at(score, at, block.term_weight[pair] * gain[post])
    item = met % width
    near = score + block.rest[item] >= best.threshold[item]
    met, score, item = met[near], score[near], item[near]
    if not len(met):
        return
    # pruned terms of the candidates, looked up in the documents' postings
    key = row * len(block.terms) + term
    order = np.argsort(key, kind="stable")
    key, got = key[order], gain[order]
    origin, pair = _ranges(block.by_item[item], block.by_item[item + 1])
    ask = (met // width)[origin] * len(block.terms) + block.item_term[pair]
    place = np.minimum(np.searchsorted(key, ask), len(key) - 1)
    hit = key[place] == ask
    np.add.at(score, origin[hit], block.item_weight[pair[hit]] * got[place[hit]])
    fine = (score >= best.threshold[item]) & (score > 0)
    r = (met // width)[fine]
    best.merge(item[fine], score[fine], doc[r], null[r])


def _score(batches: Iterator[pa.RecordBatch], held, docs: int, terms: int, k: int) -> Iterator[pa.RecordBatch]:
    block: Block = held.value
    best = Best(block, k)
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            b = batch.slice(a, SLICE)
            ids, lists = b.column(0), b.column(2)
            term = pc.index_in(lists.flatten(), block.terms)
            known = pc.is_valid(term).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))[known]
            tf = b.column(3).flatten().to_numpy()[known]
            m = 75 + 25 * b.column(1).to_numpy() * docs // max(terms, 1)
            gain = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
            null = pc.is_null(ids).to_numpy(zero_copy_only=False)
            score_slice(block, best, pc.fill_null(ids, 0).to_numpy(), null, row, pc.drop_null(term).to_numpy().astype(np.int64), gain)
    for a in range(0, len(best.item), 10_000):
        s = slice(a, a + 10_000)
        yield pa.RecordBatch.from_arrays([block.items.take(pa.array(best.item[s])), pa.array(best.doc[s], mask=best.null[s]), pa.array(best.score[s])], names=["item_id", "doc_id", "score"])


def search(documents: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents of highest score above 0 for every item: item_id, rank, doc_id, score."""
    spark = documents.sparkSession
    asked = stored(item_terms(items, item_col, item_text), "item-terms")
    held = stored(index(documents, asked, id_col, text_col), "lexical-index")
    docs, terms = held.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = stored(seeded(asked, term_gains(held, docs, terms, k), docs), "seeded")
    blocks = pairs.count() // PAIRS + 1
    found = None
    for x in range(blocks):
        block = spark.sparkContext.broadcast(_block(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == x).toArrow()))
        some = held.mapInArrow(lambda it, block=block: _score(it, block, docs, terms, k), "item_id long, doc_id long, score long")
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), g AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, big_n),
i AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL
), s AS (
  SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
