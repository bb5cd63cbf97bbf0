"""Connected components of a graph given as edges, by alternating large-star and small-star steps
(each step keeps the components and lowers labels; the number of rounds grows with the logarithm
of the component size). A node with very many edges is no problem: neighbourhoods are aggregated
to their minimum, and the join that hands the minimum back can be split by the adaptive skew join.
Every round is written to the shared folder, so a lost executor costs at most one round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): label is the smallest node of its component.
    Null ends are no edges, loops are allowed; empty edges give no rows."""
    now = written(spark, edges.where("a < b").union(edges.where("b < a").select("b", "a").toDF("a", "b")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: a node's smaller neighbours and itself hang under the smallest of them
        down = large.distinct()
        smallest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b"))).where("a <> b")
        then = written(spark, small.distinct(), "edges")
        # done when the edges are a forest of stars that a round leaves as it is
        if _same(now, then):
            break
        now = then
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return stars.union(stars.select("label", "label").distinct())


def _same(now: DataFrame, then: DataFrame) -> bool:
    marks = [df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))).alias("x")).first() for df in (now, then)]
    return marks[0] == marks[1]
