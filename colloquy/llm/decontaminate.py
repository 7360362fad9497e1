"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and split into runs of letters and digits; shingles are
five words (all words of an item with fewer).  A shingle weighs round(1000 *
ln(1 + items / items that have it)), one of no item as if one item had it.

1. Windows of each item length are laid at every start of a text where the
   shingles that some item of this length has weigh enough for the lightest of
   these items.  A window that leaves out can't reach the similarity.
2. A window and an item get a SimHash of 64 bits.  Shingles enter it by the root
   of their weight, so the cosine is at least 2J / (1 + J) for a weighted Jaccard
   similarity of J, however unequal the weights: at .8 a bit differs with a
   chance of .152.
3. Fingerprints of the same length meet in a multi-index: of 7 blocks one differs
   by RADIUS // 7 = 2 bits at most, so the items' blocks are stored with every
   change of up to two bits, and all fingerprints within the radius are found.
4. What is within the radius is verified by exact weighted Jaccard similarity
   over shingle counts, in whole numbers.

The radius is 20: a window of similarity .8 exactly is missed with a chance of
about 3 in 10,000, a nearer one with less (.85: 1 in 200,000); neighbouring
windows of a passage have chances of their own.  ``exact=True`` leaves steps 2
and 3 out and compares each window with all items of its length that share a
shingle with it.

Work is per distinct text, so copies cost one verification.

Defined results: null, empty and word-free texts and items match nothing; a text
that ends inside a window is compared as far as it goes; items of equal text are
reported each; each row of documents with a match gets a row per item, with its
best window (ties: the first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, release, small, stored, text_key, without_rows

WIDTH = 5
PERCENT = 80
BROADCAST_SHINGLES = 1_000_000
RADIUS = 20
BLOCK_BITS = (9, 9, 9, 9, 9, 9, 10)  # of the multi-index; together 64
LANES = 3  # bits of a fingerprint that are summed in one long


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(w: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, in order; empty if there are fewer words.

    ``w`` has to be a plain column: an expression would be evaluated anew for every position.
    """
    run = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(width)]))
    return F.when(F.size(w) >= width, run).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n_words, width, shingles): one row per item with words; ``item`` tells repeated ids apart."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WIDTH))
    cases = F.array().cast("array<bigint>")
    for width in range(1, WIDTH + 1):
        cases = F.when(n == width, shingles(F.col("w"), width)).otherwise(cases)
    return items.select("item_id", F.size("w").alias("n_words"), n.alias("width"), cases.alias("shingles")).distinct().withColumn("item", F.xxhash64(F.col("item_id").isNull(), F.coalesce("item_id", F.lit(0)), F.to_json("shingles")))


def _fingerprint() -> tuple[list[Column], Column]:
    """SimHash of a group's shingles (columns h, n, weight, n_words): aggregates, and the fingerprint from them.

    Three bits share a sum, each in a lane of 21 bits.  A shingle counts by the root of its weight; very long
    windows count in smaller units, so that no lane overflows.
    """
    unit = "cast(round(sqrt(n * weight) * least(1, 10000 / n_words)) as bigint)"
    lane = lambda b: f"shiftleft((shiftright(h, {b}) & 1L) * {unit}, {21 * (b % LANES)})"
    sums = [F.expr(f"sum({' + '.join(lane(b) for b in range(k, min(k + LANES, 64)))})").alias(f"_l{k}") for k in range(0, 64, LANES)]
    set_ = lambda b: f"shiftleft(cast(2 * (shiftright(_l{b - b % LANES}, {21 * (b % LANES)}) & 2097151L) > _all as bigint), {b})"
    return [F.expr(f"sum({unit})").alias("_all"), *sums], F.expr(" | ".join(map(set_, range(64))))


def _blocks(fingerprint: str) -> Column:
    """Array of (block, value) of a fingerprint."""
    starts = [sum(BLOCK_BITS[:k]) for k in range(len(BLOCK_BITS))]
    return F.expr("array(" + ", ".join(f"struct({k} as block, cast(shiftrightunsigned({fingerprint}, {at}) & {(1 << bits) - 1} as int) as value)" for k, (at, bits) in enumerate(zip(starts, BLOCK_BITS, strict=True))) + ")")


def _index(items: DataFrame) -> DataFrame:
    """(item, w0, l0, theirs, b0, v0): the blocks of the items' fingerprints with every change of up to RADIUS // 7 bits."""
    spark, top = items.sparkSession, 1 << max(BLOCK_BITS)
    bits = F.expr(f"element_at(array({', '.join(map(str, BLOCK_BITS))}), b0 + 1)")
    changes = spark.range(len(BLOCK_BITS) * top).select(F.floor(F.col("id") / top).cast("int").alias("b0"), (F.col("id") % top).cast("int").alias("change"))
    changes = changes.where((F.bit_count("change") <= RADIUS // len(BLOCK_BITS)) & (F.col("change") < F.pow(F.lit(2), bits)))  # some hundreds
    own = items.select("item", F.col("width").alias("w0"), F.col("n_words").alias("l0"), "theirs", F.explode(_blocks("theirs")).alias("b")).select("item", "w0", "l0", "theirs", F.col("b.block").alias("b0"), F.col("b.value").alias("value"))
    return own.join(F.broadcast(changes), "b0").select("item", "w0", "l0", "theirs", "b0", F.col("value").bitwiseXOR(F.col("change")).alias("v0"))


def _leaking_texts(documents: DataFrame, benchmark: DataFrame, percent: int, exact: bool) -> DataFrame:
    """(t1, t2, item_id, start_word, n_words, shared_weight, union_weight, similarity) for each distinct text and item it holds."""
    items = stored(_items(benchmark), "items")
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()]  # at most five
    spread = items.select("item", "item_id", "n_words", "width", F.explode("shingles").alias("h"))
    count = items.count()
    weight = F.round(F.log(1 + F.lit(float(max(count, 1))) / F.col("df")) * 1000).cast("bigint")
    weights = stored(spread.select("h", "item").distinct().groupBy("h").agg(F.count("*").alias("df")).select("h", weight.alias("weight")), "weights")
    # ln(1 + items): what a shingle of one item weighs
    default = F.round(F.log(F.lit(1.0 + max(count, 1))) * 1000).cast("bigint")
    sums, fingerprint = _fingerprint()
    item_counts = stored(spread.groupBy("item", "n_words", "width", "h").agg(F.count("*").alias("n")).join(weights, "h"), "counts")
    totals = item_counts.groupBy("item", "n_words", "width").agg(F.sum(F.col("n") * F.col("weight")).alias("item_weight"), *sums)
    totals = stored(totals.select("item", "n_words", "width", "item_weight", fingerprint.alias("theirs")), "items")

    # the shingles of each item length, with the weight of the lightest item of that length
    least = totals.groupBy("width", "n_words").agg(F.min("item_weight").alias("least"))
    lookup = item_counts.select("h", "width", "n_words", "weight").distinct().join(least, ["width", "n_words"])
    lookup = maybe_broadcast(lookup.select(F.col("h").alias("ih"), F.col("width").alias("iw"), "n_words", "weight", "least"), BROADCAST_SHINGLES)
    texts = documents.select(F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    hits = None
    for width in widths:
        # the outer form keeps Spark from inferring a filter that would split the text once for every word
        run = texts.select(*text_key(F.col("text")), words(F.col("text")).alias("w")).select("t1", "t2", shingles(F.col("w"), width).alias("s")).select("t1", "t2", F.posexplode_outer("s").alias("p", "h"))
        met = run.join(lookup, (F.col("h") == F.col("ih")) & (F.col("iw") == width)).select("t1", "t2", F.lit(width).alias("width"), "n_words", "p", "weight", "least")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return documents.sparkSession.createDataFrame([], "t1 bigint, t2 int, item_id bigint, start_word bigint, n_words int, shared_weight bigint, union_weight bigint, similarity double")
    starts = F.sequence(F.greatest(F.col("p") - (F.col("n_words") - F.col("width")), F.lit(0)), F.col("p"))
    laid = hits.distinct().select("t1", "t2", "width", "n_words", "weight", "least", F.explode(starts).alias("start"))
    laid = laid.groupBy("t1", "t2", "width", "n_words", "start", "least").agg(F.sum("weight").alias("most")).where(100 * F.col("most") >= percent * F.col("least"))
    laid = laid.groupBy("t1", "t2", "width", "n_words").agg(F.collect_list("start").alias("starts"))  # as many as the text has words
    laid = stored(laid, "starts")
    release(documents.sparkSession)

    keys = stored(laid.select(F.col("t1").alias("u1"), F.col("t2").alias("u2")).distinct(), "texts")
    held = maybe_broadcast(keys)
    again = texts.select(*text_key(F.col("text")), "text").join(held, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left_semi").dropDuplicates(["t1", "t2"])
    again = again.select("t1", "t2", words(F.col("text")).alias("w"))
    windows = None
    for width in widths:
        at = laid.where(F.col("width") == width)
        at = F.broadcast(at) if small(at, 200_000) else at
        cut_out = again.select("t1", "t2", shingles(F.col("w"), width).alias("s")).join(at, ["t1", "t2"])
        cut_out = cut_out.select("t1", "t2", "width", "n_words", "s", F.explode("starts").alias("start"))
        cut_out = cut_out.select("t1", "t2", "width", "n_words", "start", F.explode(F.slice("s", F.col("start") + 1, F.col("n_words") - width + 1)).alias("h"))
        windows = cut_out if windows is None else windows.unionByName(cut_out)
    by = ["t1", "t2", "width", "n_words", "start"]
    counts = windows.groupBy(*by, "h").agg(F.count("*").alias("n"))
    counts = stored(counts.join(maybe_broadcast(weights), "h", "left").withColumn("weight", F.coalesce("weight", default)), "window-counts")
    release(documents.sparkSession)

    theirs = item_counts.select(F.col("item").alias("i0"), F.col("h").alias("h0"), F.col("n").alias("n0"))
    own = counts.groupBy(*by).agg(F.sum(F.col("n") * F.col("weight")).alias("own"), *sums).select(*by, "own", fingerprint.alias("ours"))
    if exact:
        lengths = item_counts.select(F.col("item").alias("i0"), F.col("h").alias("h0"), F.col("n_words").alias("l0"), F.col("width").alias("w0"))
        met = counts.join(lengths, (F.col("h") == F.col("h0")) & (F.col("n_words") == F.col("l0")) & (F.col("width") == F.col("w0"))).select(*by, F.col("i0").alias("item")).distinct()
        near = met.join(own, by)
    else:
        asked = own.select(*by, "own", "ours", F.explode(_blocks("ours")).alias("b"))
        same = (F.col("b.block") == F.col("b0")) & (F.col("b.value") == F.col("v0")) & (F.col("n_words") == F.col("l0")) & (F.col("width") == F.col("w0"))
        near = asked.join(maybe_broadcast(stored(_index(totals), "index")), same).where(F.bit_count(F.col("ours").bitwiseXOR(F.col("theirs"))) <= RADIUS).select(*by, "own", "item").distinct()
    near = stored(near.select(*by, "own", "item"), "near")
    release(documents.sparkSession)

    both = counts.join(near, by).join(maybe_broadcast(theirs), (F.col("item") == F.col("i0")) & (F.col("h") == F.col("h0")))
    score = both.groupBy(*by, "own", "item").agg(F.sum(F.least("n", "n0") * F.col("weight")).alias("shared_weight")).join(maybe_broadcast(totals.select("item", "item_weight")), "item")
    score = score.withColumn("union_weight", F.col("own") + F.col("item_weight") - F.col("shared_weight")).where(100 * F.col("shared_weight") >= percent * F.col("union_weight"))
    score = score.withColumn("similarity", F.col("shared_weight") / F.col("union_weight"))
    best = score.groupBy("t1", "t2", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "shared_weight", "union_weight")).alias("b"))
    best = best.select("t1", "t2", "item", (-F.col("b.s")).cast("bigint").alias("start_word"), F.col("b.shared_weight"), F.col("b.union_weight"), F.col("b.similarity"))
    return stored(best.join(items.select("item", "item_id", "n_words"), "item").drop("item"), "leaks")


def _found(documents: DataFrame, benchmark: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    best = _leaking_texts(documents, benchmark, percent, exact)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text").cast("string")))
    return docs.join(maybe_broadcast(best), ["t1", "t2"])


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, shared_weight, union_weight, similarity) for each document and item it holds."""
    return _found(documents, benchmark, percent, exact).select("doc_id", "item_id", "start_word", "n_words", "shared_weight", "union_weight", "similarity")


def without_leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``documents`` less those that hold a passage of the benchmark: all rows of such a doc_id, but of rows without one only those that hold it."""

    def keys(doc_id: Column, t1: Column, t2: Column) -> list[Column]:
        return [doc_id, F.when(doc_id.isNull(), t1), F.when(doc_id.isNull(), t2)]

    gone = _found(documents, benchmark, percent).select(*keys(F.col("doc_id"), F.col("t1"), F.col("t2")))
    return without_rows(documents, gone, keys(documents["doc_id"].cast("long"), *text_key(documents["text"].cast("string"))))


ORACLE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), it AS (SELECT item_id, len(w) AS n_words, least(5, len(w)) AS width, w FROM items WHERE len(w) > 0),
ish AS (
  SELECT item_id, n_words, width, o, array_to_string(w[o : o + width - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, n_words - width + 2)) AS o FROM it)
), dsh AS (
  SELECT r, doc_id, width, p, array_to_string(w[p : p + width - 1], ' ') AS s
  FROM (SELECT r, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM docs, (SELECT DISTINCT width FROM it))
), wt AS (
  SELECT s, CAST(round(1000 * ln(1 + (SELECT count(*) FROM it)::DOUBLE / count(DISTINCT item_id))) AS BIGINT) AS weight FROM ish GROUP BY s
), ic AS (SELECT item_id, ish.s, count(*) AS n, any_value(weight) AS weight FROM ish JOIN wt USING (s) GROUP BY item_id, ish.s),
itot AS (SELECT item_id, sum(n * weight) AS iw FROM ic GROUP BY item_id),
win AS (
  SELECT DISTINCT dsh.r, dsh.doc_id, ish.item_id, n_words, ish.width, unnest(range(greatest(p - 1 - n_words + ish.width, 0), p)) AS start
  FROM dsh JOIN ish ON dsh.s = ish.s AND dsh.width = ish.width
), wc AS (
  SELECT win.r, win.doc_id, win.item_id, n_words, start, dsh.s, count(*) AS n
  FROM win JOIN dsh ON win.r = dsh.r AND win.width = dsh.width AND p BETWEEN start + 1 AND start + n_words - win.width + 1
  GROUP BY ALL
), sc AS (
  SELECT wc.r, wc.doc_id, wc.item_id, n_words, start,
         sum(wc.n * coalesce(wt.weight, CAST(round(1000 * ln(1 + (SELECT count(*) FROM it)::DOUBLE)) AS BIGINT))) AS own,
         sum(least(wc.n, coalesce(ic.n, 0)) * coalesce(wt.weight, 0)) AS shared
  FROM wc LEFT JOIN wt ON wc.s = wt.s LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.s = wc.s GROUP BY ALL
), ok AS (
  SELECT sc.*, shared::BIGINT AS sh, (own + iw - shared)::BIGINT AS un FROM sc JOIN itot USING (item_id)
  WHERE 100 * shared >= 80 * (own + iw - shared)
)
SELECT doc_id, item_id, start::BIGINT AS start_word, n_words::INTEGER AS n_words, sh AS shared_weight, un AS union_weight, sh::DOUBLE / un AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY sh::DOUBLE / un DESC, start) AS k FROM ok) WHERE k = 1
"""
