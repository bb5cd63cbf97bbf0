"""A training-data pipeline over `documents`.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame; what one returns is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`:

1. language ID: texts without a language (no letter, or a score under LEAST_SCORE) go;
2. n-gram Jaccard join: of each group of near copies the smallest doc_id stays;
3. substring dedup: passages that a smaller doc_id has are cut out of the texts; what is left
   empty by that goes;
4. benchmark decontamination: documents that hold a benchmark item go;
5. byte-level BPE: token ids of what is left, decoded again as a check.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm import decontaminate, jaccard_join, langid, prefix_bpe, substring_dedup
from tickflow.llm import queries as _queries
from tickflow.llm.common import lean
from tickflow.session import checkpoint_dir

LEAST_SCORE = 0.35
NEAR = jaccard_join.Similarity(words=5, num=80, den=100)
REMEMBERED = 400_000  # runs that the last stage's workers keep: they hold the other stages' memory too


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that have a language."""
    lean(spark)
    return langid.accepted(docs, langid.learn(docs), LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8)."""
    lean(spark)
    return jaccard_join.deduplicated(spark, docs, NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; n_chars follows the text."""
    lean(spark)
    out = substring_dedup.cut_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every document left."""
    lean(spark)
    return prefix_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, REMEMBERED)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_items),
    ("byte_level_bpe", token_ids),
]

# The first stage learns its model, which SQL can't say: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows; the stages' tables are written under the shared folder."""
    lean(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs


QUERIES = {**_queries.QUERIES, "pipeline": run}
ORACLES = dict(_queries.ORACLES)
