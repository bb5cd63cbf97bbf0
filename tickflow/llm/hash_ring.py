"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of the ring; a row's key (its doc_id) lies in the arc that ends
at the next point clockwise and belongs to that point's shard. A shard takes no more rows than its
bound; what overflows goes on clockwise to the next shard that still has room. With bounds of
floor or ceil of rows / shards the counts differ by one at most, whatever the keys: even when all
rows have one key. Movement is limited to the overflow: a row that its own shard can hold stays.

Law of the query: `rows` (row counts at most one apart).

How the overflow runs in parallel: an arc's rows have the same order of shards ahead of them, so
only counts matter. Round k offers what is left of each arc to the k-th distinct shard clockwise
from it; a shard gives its room to the arcs in ring order (a running sum over the few thousand
arcs). A row then finds its shard by its rank in its arc. Ranks come from cells (arc, salt): the
salt splits an arc, and so a hot key, over many tasks; a cell's offset is a running sum of counts.

Defined results: a null doc_id is a key like any other; null text has size 1 and the checksum
of the empty text; equal rows may go to different shards; an empty table gives no rows. Columns
named like the results are ignored unless they are doc_id or text. No Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickflow.llm.common import column, written

SHARDS = 8
VNODES = 128
SALTS = 64


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """(arc, point, targets): the sorted points; targets[k] is the k-th distinct shard met
    clockwise from the arc. shards * vnodes rows, a parameter's size."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit("vnode"), "id").alias("point"))
    order = Window.orderBy("point", "shard")  # a fixed few thousand rows
    nodes = nodes.select("shard", "point", (F.row_number().over(order) - 1).alias("arc"))
    # distance from an arc to each shard's next point, going round once
    size = shards * vnodes
    ahead = Window.orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    twice = nodes.select("shard", "arc", F.col("arc").alias("at")).union(nodes.select("shard", "arc", F.col("arc") + size))
    nexts = [F.min(F.when(F.col("shard") == s, F.col("at"))).over(ahead).alias(f"n{s}") for s in range(shards)]
    nearest = F.array_sort(F.array(*[F.struct(F.col(f"n{s}").alias("at"), F.lit(s).alias("shard")) for s in range(shards)]))
    targets = twice.select("arc", "at", *nexts).where(F.col("at") < size).select("arc", nearest["shard"].alias("targets"))
    return nodes.join(targets, "arc").select("arc", "point", "targets")


def _with_arc(rows: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """Adds the arc of the hash `h`: the number of points below it (past the last one: arc 0), by
    binary search in the sorted array of the points."""
    table = points.agg(F.array_sort(F.collect_list("point")).alias("p")).select("p").scalar()
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda found, step: F.when((found + step <= size) & (F.get("table", found + step - 1) < F.col("h")), found + step).otherwise(found))
    return rows.withColumn("table", table).withColumn("arc", F.pmod(below, F.lit(size))).drop("table")


def assign(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, salts: int = SALTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    text = F.coalesce(column(docs, "text"), F.lit(""))
    points = written(spark, ring(spark, shards, vnodes), "ring")
    rows = docs.select(
        column(docs, "doc_id").alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        F.xxhash64(F.lit("key"), column(docs, "doc_id")).alias("h"),
    )
    rows = written(spark, _with_arc(rows, points, shards * vnodes), "ring-rows")

    cells = rows.groupBy("arc", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("arc").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = written(spark, cells, "ring-cells")

    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    arcs = points.join(cells.groupBy("arc").agg(F.sum("n").alias("left")), "arc", "left").select("arc", "targets", F.coalesce("left", F.lit(0)).alias("left"))
    arcs = arcs.withColumn("done", F.lit(0).cast("bigint"))
    bounds = [F.floor(total / shards) + F.when(F.lit(s) < total % shards, 1).otherwise(0) for s in range(shards)]
    bound = F.array(*[b.cast("bigint") for b in bounds])
    # per round and shard: room left, given out in ring order
    taken = F.array(*[F.lit(0).cast("bigint")] * shards)
    arcs = arcs.withColumn("room", bound).withColumn("used", taken).withColumn("parts", F.array().cast("array<struct<shard:int,lo:bigint,hi:bigint,slot0:bigint>>"))
    for k in range(shards):
        target = F.col("targets")[k]
        in_ring_order = Window.partitionBy("target").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
        step = arcs.withColumn("target", target).withColumn("asked", F.coalesce(F.sum("left").over(in_ring_order), F.lit(0)))
        free = F.greatest(F.lit(0), F.get("room", F.col("target")) - F.col("asked"))
        step = step.withColumn("got", F.least("left", free).cast("bigint"))
        start = F.get("used", F.col("target")) + F.least(F.col("asked"), F.get("room", F.col("target")))
        part = F.struct(F.col("target").alias("shard"), F.col("done").alias("lo"), (F.col("done") + F.col("got")).alias("hi"), start.cast("bigint").alias("slot0"))
        step = step.withColumn("parts", F.when(F.col("got") > 0, F.concat("parts", F.array(part))).otherwise(F.col("parts")))
        whole = Window.partitionBy()  # the arcs: a fixed few thousand rows
        given = F.array(*[F.coalesce(F.sum(F.when(F.col("target") == s, F.col("got"))).over(whole), F.lit(0)) for s in range(shards)])
        step = step.withColumn("given", given)
        arcs = step.select(
            "arc", "targets", (F.col("left") - F.col("got")).alias("left"), (F.col("done") + F.col("got")).alias("done"),
            F.zip_with("room", "given", lambda a, b: a - b).alias("room"), F.zip_with("used", "given", lambda a, b: a + b).alias("used"), "parts",
        )
        arcs = written(spark, arcs, "ring-round")

    cells = cells.join(arcs.select("arc", "parts"), "arc").select("arc", "salt", "cell_start", "parts")
    in_cell = Window.partitionBy("arc", "salt").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("r", F.row_number().over(in_cell) - 1).join(cells, ["arc", "salt"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("cell_start"))
    part = F.filter("parts", lambda p: (p["lo"] <= F.col("r")) & (F.col("r") < p["hi"]))[0]
    return ranked.withColumn("part", part).select("doc_id", "size", "text_crc32", F.col("part.shard").alias("shard"), (F.col("part.slot0") + F.col("r") - F.col("part.lo")).alias("slot"))


def sharded(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest of the query; the law is `rows`, so no row has a grown_shard."""
    out = assign(spark, docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
