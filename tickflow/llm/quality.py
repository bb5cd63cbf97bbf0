"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once over a text and stores, per document, its measurements and one
integer of failure bits. Policies are versioned masks over those bits: applying one, or asking
what a rule costs, reads the ledger alone and never the texts again. `ablations` aggregates the
bits: per policy and rule, how many documents fail it, fail it alone (they'd be kept without the
rule) and are kept; documents are first counted by their bits, so at most 2^rules rows go further.

Defined results: a null text measures as an empty one (0 words, so `few_words` fails); repeated
rows are measured alike; an empty table gives an empty ledger. Windows are compared by 64-bit
hashes within one text. Columns named like the results are not read unless they are doc_id or text.
No shuffle, no Python: a document is measured where it is read, and no key gathers rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import SEPARATORS, column, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"

# (name, failing condition over the measurements); a rule's place is its bit.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

# version -> mask of the rules that reject
POLICIES = {
    "base": BASE,
    "lines": BASE | BIT["repeated_lines"],
    "v1": sum(BIT.values()),
}
PRODUCTION = "v1"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row. Each array is made in a projection of its own,
    as later ones refer to it more than once."""
    text = F.coalesce(column(docs, "text"), F.lit(""))
    t = docs.select(
        column(docs, "doc_id").alias("doc_id"),
        F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SEPARATORS)) != "").alias("lines"),
        F.length(F.translate(text, SEPARATORS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    t = t.select(
        "doc_id", "word_chars", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))).alias("windows"),
    )
    # windows with their places, sorted by hash, where a text has equal ones at all
    with_places = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    t = t.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(with_places)))
    last = F.size("sorted") - 1
    is_repeated = F.filter(
        "sorted",
        lambda x, i: ((i > 0) & (F.get("sorted", i - 1)["h"] == x["h"])) | ((i < last) & (F.get("sorted", i + 1)["h"] == x["h"])),
    )
    t = t.withColumn("places", F.sort_array(F.transform(is_repeated, lambda x: x["at"])))
    # words covered by the windows at the places: a window adds what the next one doesn't cover
    covered = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("bigint")
    return t.select("doc_id", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", n_repeat.alias("n_repeat_words"))


def fail_bits(rules=RULES) -> Column:
    bits = F.lit(0).cast("bigint")
    for i, (_, condition) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measurements and `fail_bits` (bit i set: rule i fails)."""
    return measured(docs).withColumn("fail_bits", fail_bits(rules))


def kept_by(version: str, policies=None) -> Column:
    """Whether a ledger's row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit((policies or POLICIES)[version]).cast("bigint")) == 0


def ablations(book: DataFrame, policies=None, rules=RULES) -> DataFrame:
    """version, rule, n_docs, n_kept, n_fail, n_fail_alone of every rule that a policy uses."""
    counts = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(mask).cast("bigint").alias("mask"), F.lit(1 << i).cast("bigint").alias("bit")) for v, mask in (policies or POLICIES).items() for i, (name, _) in enumerate(rules) if mask & (1 << i)]
    hit = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (
        counts.withColumn("c", F.explode(F.array(*cases)))
        .groupBy(F.col("c.version").alias("version"), F.col("c.rule").alias("rule"))
        .agg(F.sum("n").alias("n_docs"), total(hit == 0).alias("n_kept"), total(hit.bitwiseAND(F.col("c.bit")) != 0).alias("n_fail"), total(hit == F.col("c.bit")).alias("n_fail_alone"))
    )


def rated(docs: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """The query's digest: base measurements, base_failed and the production policy's verdict."""
    book = ledger(docs)
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("bigint")) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & kept_by(version)).alias("kept"), "fail_bits", F.lit(version).alias("policy"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), pos AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), win AS (
  SELECT rid, i, words[i:i+4] AS g FROM pos
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (5 * n_symbols > n_words)::INT
            + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT
            + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 20 * n_words)::INT AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, 'v1' AS policy
FROM b
"""
