"""Benchmark decontamination: finds benchmark items inside documents, edited copies too.

An item is compared with windows of its own number of words. Window and item have a 64-bit SimHash
of their five-word shingles; a multi-index over the fingerprints finds every item within RADIUS
bits of a window; an exact similarity of the weighted shingles then decides.

1. Seeds. A window of m shingles and an item of k need 9 * common >= 4 * (m + k) for a similarity of
   0.8, and `common` is at most the number of the window's places that hold a shingle of the item.
   Every window with that many such places is fingerprinted, in whatever order they stand; items
   of the same number of words are counted together (more windows, none less).
2. Fingerprints. Bit i is set if most shingles of the window (weighted by their number) have it.
3. Multi-index. BLOCKS blocks of 64 / BLOCKS bits; two fingerprints of distance <= RADIUS = 2 *
   BLOCKS - 1 have a block that differs in one bit at most, so items are listed under each block's
   value and its one-bit neighbours, together with their number of words. No pair within the radius
   is missed; pairs beyond it are dropped by their exact distance.
4. Similarity: sum of the smaller over sum of the larger weights (a shingle's weight is its number
   of occurrences); at least 0.8.

Words are split at white space after lower-casing and without the punctuation of PUNCTUATION.
Defined results: null or wordless texts hold nothing; items of fewer than five words have no
shingle and aren't searched; a text shorter than an item is one window; repeated rows are found
once per doc_id and text; empty tables give no rows; only doc_id, text and item_id, text are read.

Scale: one pass over the texts with a hash join against the items' shingles, broadcast if there
are at most MAX_BROADCAST of them (else shuffled, same results); a second pass over the texts
that have seeds. Groups are windows, so a passage that a third of all documents hold is a third
of the windows, spread by document. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.common import SPLIT_REGEX, column, written

SHINGLE = 5
BITS, BLOCKS = 64, 8
RADIUS = 2 * BLOCKS - 1
NUM, DEN = 4, 5  # similarity of 0.8
MAX_BROADCAST = 1_000_000
PUNCTUATION = ".,;:!?\"'()[]"


def _hashes(text: Column) -> Column:
    """Hash of every word of a text."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    words = F.filter(F.split(plain, SPLIT_REGEX), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(words: str) -> Column:
    """Hash of every five words in a row, from an array of word hashes."""
    at = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))


def _fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash `print` and number of shingles `m` per group of rows (keys, h)."""
    sums = [F.sum(F.getbit("h", F.lit(i)).cast("int")).alias(f"s{i}") for i in range(BITS)]
    grouped = shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums)
    bits = [F.when(2 * F.col(f"s{i}") > F.col("m"), F.expr(f"shiftleft(1L, {i})")).otherwise(F.lit(0).cast("bigint")) for i in range(BITS)]
    value = bits[0]
    for b in bits[1:]:
        value = value.bitwiseOR(b)
    return grouped.select(*keys, "m", value.alias("print"))


def _blocks(df: DataFrame, neighbours: bool) -> DataFrame:
    """One row per block of `print` (and per value one bit away from it)."""
    size = BITS // BLOCKS
    flips = [0, *(1 << b for b in range(size))] if neighbours else [0]
    cells = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", k * size).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")).bitwiseXOR(F.lit(f).cast("bigint")).alias("value"))
        for k in range(BLOCKS)
        for f in flips
    ]
    return df.withColumn("cell", F.explode(F.array(*cells))).select("*", "cell.block", "cell.value").drop("cell")


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, n, at, h) of every shingle of every item; items of equal words count as one, the
    smallest item_id."""
    words = items.select(column(items, "item_id").alias("item_id"), _hashes(column(items, "text")).alias("words"))
    words = words.groupBy("words").agg(F.min("item_id").alias("item_id")).where(F.size("words") >= SHINGLE)
    return words.select("item_id", F.size("words").alias("n"), F.posexplode(_shingles("words")).alias("at", "h"))


def _dense(seeds: DataFrame) -> DataFrame:
    """(doc_id, tid, n, start) of every window with enough seeds, from a text's sorted places `p`.
    The window's first seed is the i-th of them: it starts after the one before, and reaches the
    (i + need - 1)-th. So each start comes once."""
    m = f"(least(size, n) - {SHINGLE - 1})"
    k = f"(n - {SHINGLE - 1})"
    need = f"(({NUM} * ({m} + {k}) + {NUM + DEN - 1}) div {NUM + DEN})"
    seeds = seeds.withColumn("m", F.expr(m)).withColumn("need", F.expr(need).cast("int")).where("size(p) >= need")
    runs = F.expr("""transform(sequence(0, size(p) - need), i -> struct(
        greatest(p[i + need - 1] - m + 1, if(i = 0, 0, p[greatest(i - 1, 0)] + 1), 0) as lo,
        least(p[i], greatest(size - n, 0)) as hi))""")
    runs = seeds.select("doc_id", "tid", "n", F.explode(runs).alias("r")).where("r.lo <= r.hi")
    return runs.select("doc_id", "tid", "n", F.explode(F.sequence("r.lo", "r.hi")).alias("start"))


def find(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, tid, item_id, start_word, n_words, distance, similarity): per document text (tid: its
    hash) and item the most similar window (the first of equals) of similarity >= 0.8."""
    pieces = written(spark, item_shingles(items), "dc-items")
    few = pieces.count() <= MAX_BROADCAST
    by_hash = pieces.groupBy("h").agg(F.collect_set("n").alias("lengths"))

    text = column(docs, "text")
    hashed = docs.select(column(docs, "doc_id").alias("doc_id"), F.xxhash64(text).alias("tid"), _hashes(text).alias("words"))
    grams = hashed.select("doc_id", "tid", F.size("words").alias("size"), F.posexplode(_shingles("words")).alias("pos", "h"))
    seeds = grams.join(F.broadcast(by_hash) if few else by_hash, "h").select("doc_id", "tid", "size", "pos", F.explode("lengths").alias("n"))
    windows = _dense(seeds.groupBy("doc_id", "tid", "size", "n").agg(F.array_sort(F.collect_set("pos")).alias("p")))
    windows = written(spark, windows.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("n", "start")).alias("windows")), "dc-windows")

    # the windows' shingles, from the texts that have windows
    same = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("tid") == F.col("w_tid"))
    wanted = windows.select(F.col("doc_id").alias("w_doc"), F.col("tid").alias("w_tid"), "windows")
    texts = docs.select(column(docs, "doc_id").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text")).join(wanted, same)
    cut = texts.select("doc_id", "tid", "windows", _hashes(F.col("text")).alias("words")).dropDuplicates(["doc_id", "tid"])
    cut = cut.select("doc_id", "tid", "windows", _shingles("words").alias("grams")).select("doc_id", "tid", "grams", F.explode("windows").alias("w"))
    cut = cut.select("doc_id", "tid", F.col("w.n").alias("n"), F.col("w.start").alias("start"), F.explode(F.expr(f"slice(grams, w.start + 1, w.n - {SHINGLE - 1})")).alias("h"))
    cut = written(spark, cut, "dc-shingles")

    keys = ["doc_id", "tid", "n", "start"]
    prints = _fingerprints(cut, keys)
    item_prints = _fingerprints(pieces.select("item_id", "n", "h"), ["item_id", "n"]).select("item_id", "n", F.col("m").alias("item_m"), F.col("print").alias("item_print"))
    index = _blocks(item_prints.withColumn("print", F.col("item_print")), neighbours=True).drop("print")
    near = _blocks(prints, neighbours=False).join(index, ["n", "block", "value"])
    near = near.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).cast("int")).where(F.col("distance") <= RADIUS)
    near = near.select(*keys, "m", "item_id", "item_m", "distance").distinct()

    weights = cut.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("c"))
    item_weights = pieces.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("ic"))
    on = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.tid") == F.col("y.tid")) & (F.col("x.n") == F.col("y.n")) & (F.col("x.start") == F.col("y.start"))
    pairs = near.alias("x").join(weights.alias("y"), on).select("x.*", "y.h", "y.c").join(item_weights, ["item_id", "h"])
    common = pairs.groupBy(*keys, "m", "item_id", "item_m", "distance").agg(F.sum(F.least("c", "ic")).alias("common"))
    union = F.col("m") + F.col("item_m") - F.col("common")
    hits = common.where(DEN * F.col("common") >= NUM * union).withColumn("similarity", F.col("common") / union)
    best = hits.groupBy("doc_id", "tid", "item_id").agg(F.max_by(F.struct("start", "n", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("doc_id", "tid", "item_id", F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"))


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's rows: doc_id, item_id, start_word, n_words, distance, similarity of every leak."""
    return find(spark, docs, items).select("doc_id", "item_id", "start_word", "n_words", "distance", "similarity")


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` whose text holds no item."""
    found = written(spark, find(spark, docs, items).select(F.col("doc_id").alias("leak_doc"), F.col("tid").alias("leak_tid")).distinct(), "dc-found")
    names = docs.columns
    rows = docs.select(column(docs, "doc_id").alias("leak_key"), F.xxhash64(column(docs, "text")).alias("leak_text"), *[column(docs, n).alias(f"_{i}") for i, n in enumerate(names)])
    rows = rows.join(found, F.col("leak_key").eqNullSafe(F.col("leak_doc")) & (F.col("leak_text") == F.col("leak_tid")), "left_anti")
    return rows.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
