"""URL filter: rules first, then exact membership in a block list by a Bloom filter cascade.

The cascade works over the complete universe of keys (here: every host of the corpus). Level 0 is a
Bloom filter of the listed keys; level 1 a filter of the unlisted keys that level 0 lets pass;
level 2 of the listed keys that level 1 lets pass; and so on until no false positive is left. A
key is then decided by the first level that refuses it, with no error for any key of the universe
and no join: a level is one array of 64-bit words that an expression probes.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and is
allowed unless the empty host is listed (it never is by `hosts_under_a_block`). Repeated rows are
judged alike. Empty tables give empty results; an empty list gives an empty cascade. Other columns
of the input, whatever their names, are not touched and not returned.

Scale: building needs one distinct over the keys (partial aggregates, so a key with a third of
all rows is one row per task) and about log2(universe) passes over halving rests. The filter
holds about 1.44 * log2(unlisted / listed) + 3 bits a listed key. Its size is computed before it
is built: beyond `max_bits` (32 MiB by default) the list is not broadcast at all and membership
is an equi-join on the key, with the same results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.common import ascii_lower, column, written

MAX_BITS = 1 << 28
MAX_LEVELS = 200

# Rules of the query: (action, host, path prefix).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; '' if there is none."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, nulls if none does. A rule fits its host and
    every subdomain of it when the path starts with the rule's path."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest ends up first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


@dataclass
class Level:
    """One Bloom filter: `bits` positions in a one-row table `words` (array of bigint)."""

    number: int
    bits: int
    hashes: int
    words: DataFrame

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.number), F.lit(i), key), F.lit(self.bits).cast("bigint")) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        """True for every encoded key and for false positives."""
        words, all_set = self.words.select("words").scalar(), F.lit(True)
        for pos in self.positions(key):
            word = F.element_at(words, (F.shiftright(pos, 6) + 1).cast("int"))
            all_set = all_set & (F.getbit(word, (pos % 64).cast("int")) == 1)
        return all_set


@dataclass
class Cascade:
    levels: list[Level]

    def listed(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        verdict = F.lit(len(self.levels) % 2 == 1) if self.levels else F.lit(False)
        for level in reversed(self.levels):
            verdict = F.when(level.holds(key), verdict).otherwise(F.lit(level.number % 2 == 1))
        return verdict


def bits_needed(listed: int, unlisted: int) -> tuple[int, int]:
    """(bits, hash functions) of level 0, whose false positives halve the later levels' work."""
    rate = min(0.5, listed / max(1, unlisted) / math.sqrt(2))
    hashes = max(1, round(-math.log2(rate)))
    return max(64, math.ceil(listed * hashes / math.log(2))), hashes


def build_cascade(spark: SparkSession, keys: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """`keys`: rows (key, listed), every key of the universe once. None when level 0 would be
    larger than `max_bits`."""
    rest = written(spark, keys.select("key", "listed"), "url-keys")
    levels: list[Level] = []
    while len(levels) < MAX_LEVELS:
        side = len(levels) % 2 == 0  # even levels encode listed keys
        counts = {r["listed"]: r["n"] for r in rest.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
        own, other = counts.get(side, 0), counts.get(not side, 0)
        if not own:
            return Cascade(levels)
        bits, hashes = bits_needed(own, other) if not levels else (max(64, math.ceil(own / math.log(2))), 1)
        if bits > max_bits:
            return None
        level = Level(len(levels), bits, hashes, None)
        level.words = written(spark, _bloom_words(spark, rest.where(F.col("listed") == side), level), "url-level")
        levels.append(level)
        if not other:
            return Cascade(levels)
        rest = written(spark, rest.where((F.col("listed") == side) | level.holds(F.col("key"))), "url-rest")
    raise RuntimeError("the cascade doesn't end: keys of both sides share their hashes")


def _bloom_words(spark: SparkSession, keys: DataFrame, level: Level) -> DataFrame:
    """One row: the filter as a dense array of 64-bit words (its size is bounded by max_bits)."""
    at = F.explode(F.array(*level.positions(F.col("key"))))
    set_bits = keys.select(at.alias("pos")).select(F.shiftright("pos", 6).alias("w"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("b"))
    empty = spark.range(math.ceil(level.bits / 64)).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = set_bits.union(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("x")).select(F.col("x.b").alias("words"))


def hosts_under_a_block(judged: DataFrame) -> DataFrame:
    """The universe with its list: every host once, listed if a rule blocks any page of it."""
    return judged.groupBy(F.col("host").alias("key")).agg(F.coalesce(F.max(F.col("action") == "block"), F.lit(False)).alias("listed"))


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, decided_by of every page: the longest fitting rule
    decides; without one the page is blocked if its host is listed, which the cascade answers."""
    url = column(pages, "url")
    parts = pages.select(column(pages, "page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rule, action = rule_verdict(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    keys = hosts_under_a_block(judged)
    cascade = build_cascade(spark, keys, max_bits)
    if cascade is None:
        listed = keys.where("listed").select(F.col("key").alias("host"), F.lit(True).alias("listed"))
        judged = judged.join(listed, "host", "left")
        listed = F.coalesce(F.col("listed"), F.lit(False))
    else:
        listed = cascade.listed(F.col("host"))
    verdict = F.coalesce(F.col("action"), F.when(listed, F.lit("block")).otherwise(F.lit("allow")))
    by = F.when(F.col("action").isNull(), F.lit("list")).otherwise(F.lit("rule"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("decided_by"))


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM split
), acted AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS action FROM ruled
), listed AS (
  SELECT DISTINCT host FROM acted WHERE action = 'block'
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN action IS NULL THEN 'list' ELSE 'rule' END AS decided_by
FROM acted
"""
