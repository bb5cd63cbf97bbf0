"""N-gram Jaccard join with filters under several global token orders.

Two documents link when the Jaccard similarity of their sets of word shingles reaches num / den.
In any global order of the shingles a linked pair shares l shingles among the first
n - ceil(t * n) + l of each set (its prefix; l is a twentieth of the smaller set), so a candidate
must pass that test in every order.

1. Sets. Documents of equal sets (copies) become one node. Two 64-bit sums tell sets apart; the first
   one names the node, and where different sets share it (`Names`), they get names of their own.
2. Orders. All orders put rare shingles first: up to `hot` most frequent ones (counted in every task
   over all documents, summed) come last, by count; the rest by one of several hashes. Any order
   is right, so the counts only decide the work: boilerplate that many documents hold gets into a
   prefix only where a document has little else.
3. Candidates of the first order, from an index of prefixes. If the first common shingle stands at
   places i and j, i shingles of the one set and j of the other aren't shared, so i <= a - o and
   j <= b - o for the overlap o that sets of these sizes need. A posting is kept while its place
   allows that at all, a set only while it has as many postings left as it must share.
4. The other orders' prefixes are intersected for each candidate pair, and only then the sets, whose
   exact overlap decides.
5. Instead of all pairs of a list, first each member against the member of smallest place (a star);
   then the pairs that are left between different components. Pairs inside a component can't
   change it, so a large group of near copies costs about its size, not its square.
   `links` needs all of them: it compares all pairs of a list. Both deal long lists in blocks of
   LIST_BLOCK, so that no key of a join holds a whole list.

Defined results: A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``; a text with fewer words
than a shingle has its whole sequence as the one shingle; null or wordless text has an empty set
and is its own component; repeated rows are equal sets; rows of one doc_id are one node; a row
without doc_id has component_id null and links nothing; empty tables give no rows. Only doc_id
and text are read.

Scale: a shuffle of the prefixes (20 % of the shingles at 0.85) and one of the texts that have a
posting left; both keyed by hashes. Broadcast: `hot` tokens with counts (2 MB by default), and the
sets that share a name: about n * n / 2^64 of n different ones (some 140 of 5 * 10^10).
Every step is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.common import U64, Words, as_long, column, list_of_long, mix, sliced, windows, written
from tickflow.llm.components import components

FLUSH = 1_500_000  # shingles that a task counts at once
LIST_BLOCK = 512  # sets of one list that a key of the join of all pairs holds on each side


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; linked from num / den on; `orders` token orders. A set's name has
    `bits` bits: with few of them (tests) many sets share one."""

    words: int = 4
    num: int = 85
    den: int = 100
    orders: int = 3
    hot: int = 1 << 17
    bits: int = 64

    def shared(self, n: str) -> str:
        """Shingles that two sets of at least n share in their prefixes (SQL)."""
        return f"greatest(1L, ({n} * {self.den - self.num} + {3 * self.den - 1}) div {3 * self.den})"

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + max(1, -(-n * (self.den - self.num) // (3 * self.den)))

    def least(self, n: str) -> str:
        """Size of the smallest set that can link to one of n (SQL)."""
        return f"(({n} * {self.num} + {self.den - 1}) div {self.den})"

    def alone(self, a: str, b: str) -> str:
        """Shingles that a set of size a may have without a linked one of size b (SQL)."""
        return f"({a} - (({self.num} * ({a} + {b}) + {self.num + self.den - 1}) div {self.num + self.den}))"

    def sizes(self, a, b):
        return f"({self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b}))"


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    words = Words(texts, lower=True)
    h = words.hashes()
    runs, bounds, out = windows(h, k), words.bounds, []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - start >= k:
            out.append(np.unique(runs[start : end - k + 1]))
        elif end > start:
            out.append(windows(h[start:end], end - start) ^ U64(end - start))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_sums(sets: list[np.ndarray], bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums over each set, the first one cut to `bits`."""
    one = [mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64) + U64(len(s)) for s in sets]
    two = [mix(s + U64(0x1234567890ABCDEF)).sum(dtype=U64) for s in sets]
    return np.array(one, U64) & U64((1 << bits) - 1), np.array(two, U64)


class Names:
    """The 64-bit names of sets: the first sum, but a name of their own for sets that share it."""

    def __init__(self, rows: list | None = None):
        self.own = {(r["s1"], r["s2"]): r["sid"] for r in rows or []}
        self.shared = np.array(sorted({s1 for s1, _ in self.own}), np.int64).view(U64)

    def of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = one.copy()
        for i in np.flatnonzero(np.isin(one, self.shared)).tolist():
            key = (int(one[i : i + 1].view(np.int64)[0]), int(two[i : i + 1].view(np.int64)[0]))
            out[i : i + 1] = np.array([self.own[key]], np.int64).view(U64)
        return out


def _named(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, Names]:
    """(doc_id, n, sid) of the rows, and the names: different sets (s1, s2) have different ones."""
    first = lambda df: df.select("doc_id", "n", F.col("s1").alias("sid"))
    shared = rows.groupBy("s1").agg(F.min("s2").alias("lo"), F.max("s2").alias("hi")).where("lo < hi").select("s1")
    shared = written(spark, rows.join(shared, "s1", "left_semi").select("s1", "s2").distinct(), "jj-shared")
    if shared.isEmpty():
        return first(rows), Names()
    salt = 0
    while True:  # a new name is as unlikely to be taken as any: one round nearly always
        own = shared.withColumn("sid", F.xxhash64(F.lit(salt), "s1", "s2"))
        alone = rows.select("s1").distinct().join(shared.select("s1").distinct(), "s1", "left_anti")
        if own.select("sid").union(alone).groupBy("sid").count().where("count > 1").isEmpty():
            break
        salt += 1
    names = rows.join(own, ["s1", "s2"], "left").select("doc_id", "n", F.coalesce("sid", "s1").alias("sid"))
    return written(spark, names, "jj-members"), Names(own.collect())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))


def signatures(docs: DataFrame, by: Similarity) -> DataFrame:
    """(doc_id, n, s1, s2) of every row, and beside them (token, cnt): shingles that a task has met
    in two or more documents. One pass over the texts makes both."""

    def run(batches):
        held, size = [], 0
        empty = lambda n: pa.nulls(n, pa.int64())
        names = ["doc_id", "n", "s1", "s2", "token", "cnt"]

        def counted():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            m = len(tokens)
            return pa.RecordBatch.from_arrays([empty(m), empty(m), empty(m), empty(m), as_long(tokens), pa.array(counts.astype(np.int64))], names)

        for batch in batches:
            for piece in sliced(batch, "text"):
                sets = shingle_sets(piece.column("text"), by.words)
                s1, s2 = set_sums(sets, by.bits)
                m = len(sets)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), as_long(s1), as_long(s2), empty(m), empty(m)], names)
                held += sets
                size += sum(map(len, sets))
                if size > FLUSH:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return _rows(docs).mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, token bigint, cnt bigint")


def _hot_tokens(spark: SparkSession, counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens and their counts: all of 2^b or more, for the smallest b that gives
    at most `most` of them (no more than those come to the driver)."""
    counts = written(spark, counts.withColumn("bits", F.floor(F.log2("cnt")).cast("int")), "jj-counts")
    sizes = {r["bits"]: r["n"] for r in counts.groupBy("bits").agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least, held = 64, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    hot = counts.where(F.col("bits") >= least).select("token", "cnt").toPandas()
    return hot["token"].to_numpy(np.int64).view(U64), hot["cnt"].to_numpy(np.int64)


class Orders:
    """The global orders: by count among the hot tokens (0 for others), then by hash."""

    def __init__(self, by: Similarity, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.by, self.tokens, self.counts = by, tokens[order], counts[order]

    def prefixes(self, shingles: np.ndarray, orders=None) -> list[np.ndarray]:
        """The prefix of a set under each order, first shingle first."""
        count = np.zeros(len(shingles), np.int64)
        if len(self.tokens) and len(shingles):
            at = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
            count = np.where(self.tokens[at] == shingles, self.counts[at], 0)
        size = self.by.prefix(len(shingles)) if len(shingles) else 0
        out = []
        for i in orders if orders is not None else range(self.by.orders):
            key = shingles if i == 0 else mix(shingles ^ U64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
            out.append(shingles[np.lexsort((key, count))[:size]])
        return out


def _prefix_rows(docs: DataFrame, orders: Orders, names: Names) -> DataFrame:
    """(sid, n, prefix) under the first order of every set that a task meets (once a task, so that
    copies don't pile up)."""
    k = orders.by.words

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            for piece in sliced(batch, "text"):
                sets = shingle_sets(piece.column("text"), k)
                sid = names.of(*set_sums(sets, orders.by.bits))
                new = [i for i, s in enumerate(sid.tolist()) if len(sets[i]) and not (s in met or met.add(s))]
                sets, sid = [sets[i] for i in new], sid[new]
                first = [orders.prefixes(s, [0])[0] for s in sets]
                flat = np.concatenate(first) if first else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([as_long(sid), pa.array([len(s) for s in sets], pa.int32()), list_of_long(flat, [len(f) for f in first])], ["sid", "n", "prefix"])

    return _rows(docs).mapInArrow(run, "sid bigint, n int, prefix array<bigint>")


def _set_rows(rows: DataFrame, orders: Orders, names: Names) -> DataFrame:
    """(sid, n, tokens, p1, p2, ..): whole sets and their prefixes under the other orders."""
    k, others = orders.by.words, list(range(1, orders.by.orders))

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                sets = shingle_sets(piece.column("text"), k)
                sid = names.of(*set_sums(sets, orders.by.bits))
                prefixes = [orders.prefixes(s, others) for s in sets]
                lists = [sets, *([p[i] for p in prefixes] for i in range(len(others)))]
                made = [list_of_long(np.concatenate(x) if x else np.zeros(0, U64), [len(y) for y in x]) for x in lists]
                yield pa.RecordBatch.from_arrays([as_long(sid), pa.array([len(s) for s in sets], pa.int32()), *made], ["sid", "n", "tokens", *(f"p{i}" for i in others)])

    fields = ", ".join(f"p{i} array<bigint>" for i in others)
    return rows.mapInArrow(run, f"sid bigint, n int, tokens array<bigint>{', ' if fields else ''}{fields}")


def _verified(pairs: DataFrame, sets: DataFrame, by: Similarity) -> DataFrame:
    """The linked ones of distinct pairs (a, b): prefixes of the other orders, then the sets."""
    side = lambda cols, s: sets.select(F.col("sid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    others = [f"p{i}" for i in range(1, by.orders)]
    if others:
        both = pairs.join(side(["n", *others], "a"), "a").join(side(["n", *others], "b"), "b")
        for p in others:
            both = both.where(F.size(F.array_intersect(f"{p}_a", f"{p}_b")) >= F.expr(by.shared("least(n_a, n_b)")))
        pairs = both.select("a", "b")
    both = pairs.join(side(["n", "tokens"], "a"), "a").join(side(["n", "tokens"], "b"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    both = both.withColumn("total", F.expr("n_a + n_b - common"))
    return both.where(f"cast({by.den} as bigint) * common >= cast({by.num} as bigint) * total").select("a", "b", "common", "total")


def _indexed(spark: SparkSession, docs: DataFrame, by: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, n, sid), the postings that can link (with their list's pivot), and the sets
    that have one."""
    passed = written(spark, signatures(docs, by), "jj-signatures")
    members, names = _named(spark, passed.where("n is not null").select("doc_id", "n", "s1", "s2"))

    orders = Orders(by, *_hot_tokens(spark, passed.where("token is not null").groupBy("token").agg(F.sum("cnt").alias("cnt")), by.hot))

    # postings of tokens that two sets hold in their prefixes
    postings = _prefix_rows(docs, orders, names).select("sid", "n", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    # (all columns are read on this side too, so that one exchange serves both)
    lists = postings.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.max("n").alias("n"), F.max("pos").alias("pos"))
    lists = lists.where("lo < hi and n > 0 and pos >= 0").select("token")
    alive = postings.join(lists.hint("shuffle_hash"), "token")
    alive = written(spark, alive.select("token", "sid", "n", "pos").distinct(), "jj-postings")
    enough = alive.groupBy("sid").agg(F.count(F.lit(1)).alias("left"), F.first("n").alias("n")).where(f"left >= {by.shared(by.least('n'))}").select("sid")
    alive = alive.join(enough, "sid", "left_semi").where(f"pos <= n - {by.least('n')}")
    alive = written(spark, alive, "jj-postings")
    lists = alive.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("pos", "sid", "n")).alias("pivot")).where("held > 1")
    alive = alive.join(lists, "token")
    alive = written(spark, alive.select("token", "sid", "n", "pos", F.col("pivot.sid").alias("psid"), F.col("pivot.n").alias("pn"), F.col("pivot.pos").alias("ppos")), "jj-postings")

    # the texts of the sets that have a posting left
    named = members.where("doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wanted = named.join(alive.select("sid").distinct(), "sid", "left_semi").select("doc_id")
    rows = _rows(docs)
    sets = written(spark, _set_rows(rows.join(wanted.distinct(), "doc_id", "left_semi"), orders, names), "jj-sets")
    return members, alive, sets


def _pairs_of_lists(postings: DataFrame, by: Similarity, block: int, only: str = "true") -> DataFrame:
    """The distinct pairs (a, b) of sets of one list that can link by their sizes and places, where
    `only` holds of the postings x and y. A list is cut into blocks by hash; a key of the join holds
    two blocks of one list."""
    held = postings.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    cells = postings.join(held, "token").withColumn("of", F.expr(f"cast(ceil(held / {block}) as int)"))
    cells = cells.withColumn("own", F.expr("cast(pmod(xxhash64(sid), of) as int)")).drop("held")
    x = cells.select("*", F.col("own").alias("lo"), F.explode(F.expr("sequence(own, of - 1)")).alias("hi")).drop("own", "of").alias("x")
    y = cells.select("*", F.explode(F.expr("sequence(0, own)")).alias("lo"), F.col("own").alias("hi")).drop("own", "of").alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    pairs = x.join(y, same & F.expr(f"(x.lo < x.hi or x.sid < y.sid) and ({only})") & F.expr(by.sizes("x.n", "y.n")) & F.expr(f"x.pos <= {by.alone('x.n', 'y.n')} and y.pos <= {by.alone('y.n', 'x.n')}"))
    return pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def links(spark: SparkSession, docs: DataFrame, by: Similarity = Similarity(), block: int = LIST_BLOCK) -> DataFrame:
    """Every link between two different sets, once: a, b (the smallest doc_id of each, a <= b),
    copies_a, copies_b (number of its doc_ids), n_common, n_union (shingles). So the number of links
    between documents of different sets is the sum of copies_a * copies_b."""
    members, alive, sets = _indexed(spark, docs, by)
    pairs = written(spark, _pairs_of_lists(alive.select("token", "sid", "n", "pos"), by, block), "jj-pairs")
    # (a set of several doc_ids that have more texts can stand in `sets` more than once)
    found = written(spark, _verified(pairs, sets.dropDuplicates(["sid"]), by), "jj-links")

    named = members.where("doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc"), F.countDistinct("doc_id").alias("copies"))
    end = lambda s: named.select(F.col("sid").alias(s), F.struct("doc", "copies").alias(f"of_{s}"))
    out = found.join(end("a"), "a").join(end("b"), "b").select(F.least("of_a", "of_b").alias("x"), F.greatest("of_a", "of_b").alias("y"), "common", "total")
    return out.select(
        F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.copies").alias("copies_a"), F.col("y.copies").alias("copies_b"),
        F.col("common").cast("bigint").alias("n_common"), F.col("total").cast("bigint").alias("n_union"),
    )


def linked(spark: SparkSession, docs: DataFrame, by: Similarity = Similarity(), block: int = LIST_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    members, alive, sets = _indexed(spark, docs, by)
    star = alive.where("sid <> psid").where(by.sizes("n", "pn")).where(f"pos <= {by.alone('n', 'pn')} and ppos <= {by.alone('pn', 'n')}")
    star = written(spark, star.select(F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b")).distinct(), "jj-star")
    links = written(spark, _verified(star, sets, by).select("a", "b"), "jj-links")
    label = written(spark, components(spark, links), "jj-labels")

    # pairs of one list that stand in different components and haven't been compared
    placed = alive.join(label, alive["sid"] == label["node"], "left").select("token", "sid", "n", "pos", F.coalesce("label", "sid").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    left = written(spark, placed.join(mixed, "token", "left_semi"), "jj-mixed")
    cross = _pairs_of_lists(left, by, block, "x.c <> y.c").join(star, ["a", "b"], "left_anti")
    more = written(spark, _verified(cross, sets, by).select("a", "b"), "jj-more")

    # rows of one doc_id are one node too
    twice = members.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi")
    same = members.join(twice, "doc_id").select(F.col("lo").alias("a"), F.col("sid").alias("b"))
    label = components(spark, links.union(more).union(same))
    grouped = members.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = grouped.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = grouped.join(smallest, "label", "left")
    lone = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(lone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def deduplicated(spark: SparkSession, docs: DataFrame, by: Similarity) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component (one document of each group;
    rows without doc_id stay)."""
    out = linked(spark, docs, by)
    dropped = written(spark, out.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "jj-dropped")
    return docs.join(dropped, column(docs, "doc_id") == F.col("gone"), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), long AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 4
), s AS (
  SELECT DISTINCT doc_id, words[i:i+3] AS g FROM long
  UNION ALL SELECT doc_id, words FROM w WHERE len(words) BETWEEN 1 AND 3
), sized AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sized sa ON sa.doc_id = a JOIN sized sb ON sb.doc_id = b WHERE 100 * c >= 85 * (sa.n + sb.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
)
SELECT w.doc_id, CAST(coalesce(sized.n, 0) AS BIGINT) AS n_shingles, component_id
FROM w LEFT JOIN sized USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""

# As above, over the smallest doc_id of each set.
LINKS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), long AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 4
), s AS (
  SELECT DISTINCT doc_id, words[i:i+3] AS g FROM long
  UNION ALL SELECT doc_id, words FROM w WHERE len(words) BETWEEN 1 AND 3
), sets AS (
  SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS k FROM s GROUP BY doc_id
), named AS (
  SELECT min(doc_id) AS doc_id, any_value(n) AS n, count(*) AS copies FROM sets GROUP BY k
), t AS (
  SELECT s.doc_id, g FROM s JOIN named USING (doc_id)
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
)
SELECT a, b, x.copies AS copies_a, y.copies AS copies_b, c AS n_common, x.n + y.n - c AS n_union
FROM pairs JOIN named x ON x.doc_id = a JOIN named y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
"""
