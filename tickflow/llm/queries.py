"""One query per operator over its whole table, and the pipeline; the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickflow.llm import decontaminate, hard_negatives, hash_ring, jaccard_join, langid, periodic_runs, prefix_bpe, quality, substring_dedup, token_count, toxicity, url_filter, warc
from tickflow.llm.common import lean

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            lean(spark)
            return fn(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@_query("op1_url_filter", url_filter.ORACLE_SQL)
def _op1(spark, table):
    """Rules, then the host list by a Bloom filter cascade."""
    return url_filter.judge(spark, table("pages"))


@_query("op2_token_counts")
def _op2(spark, table):
    """Token counts of every whole text by the SentencePiece model."""
    return token_count.token_counts(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op3_decontaminate")
def _op3(spark, table):
    """Benchmark items found in documents by SimHash windows and exact similarity."""
    return decontaminate.leaks(spark, table("documents"), table("benchmark"))


@_query("op4_prefix_bpe")
def _op4(spark, table):
    """Byte-level BPE of every whole text and back."""
    return prefix_bpe.round_trip(table("documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op5_jaccard_join", jaccard_join.ORACLE_SQL)
def _op5(spark, table):
    """Components of documents with Jaccard similarity >= 0.85 on 4-word shingles."""
    return jaccard_join.linked(spark, table("documents"))


@_query("jaccard_links", jaccard_join.LINKS_SQL)
def _op5_links(spark, table):
    """Every link of operator 5 between different sets, with the copies that each stands for."""
    return jaccard_join.links(spark, table("documents"))


@_query("op6_hash_ring")
def _op6(spark, table):
    """Rows into shards 0 to 7 by a consistent-hash ring with bounded loads."""
    return hash_ring.sharded(spark, table("documents"))


@_query("op7_warc", warc.ORACLE_SQL)
def _op7(spark, table):
    """Every page through Zstandard WARC archives and back."""
    return warc.archived(spark, table("pages"))


@_query("op8_quality_ledger", quality.ORACLE_SQL)
def _op8(spark, table):
    """Rule bitmask ledger of every document and the production policy's verdict."""
    return quality.rated(table("documents"))


@_query("op9_langid")
def _op9(spark, table):
    """Language of every whole text by a linear-chain conditional random field."""
    return langid.identified(table("documents"))


@_query("op10_substring_dedup", substring_dedup.ORACLE_SQL)
def _op10(spark, table):
    """Words left of every text when windows that a smaller doc_id has go."""
    return substring_dedup.removed(table("documents"))


@_query("op11_toxicity")
def _op11(spark, table):
    """Toxicity of every whole text by a weighted grammar over clauses."""
    return toxicity.scored(spark, table("documents"), table("labels"))


@_query("op12_hard_negatives", hard_negatives.ORACLE_SQL)
def _op12(spark, table):
    """Hard negatives of every fiftieth vector by angular triangle filtering."""
    return hard_negatives.mined(spark, hard_negatives.relabelled(table("embeddings")))


@_query("op13_periodic_runs")
def _op13(spark, table):
    """Periodic runs of every whole text, and the texts with each run cut to its first period."""
    return periodic_runs.digests(table("documents"))
