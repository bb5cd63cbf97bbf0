"""Late rows of a message stream, kept and accounted for.

The engine's watermark drops late rows and tells their number only. Here a ``foreachBatch`` callback
holds the watermark itself, as a table per micro-batch: the greatest sequence number and arrival of
each topic so far. Of every row of a batch it knows whether

* ``window_closed``: its window (X4) ended at or before the watermark, the greatest arrival of all
  earlier batches less the delay;
* ``out_of_order``: its number isn't above its topic's greatest one of earlier batches, so the last-N
  gauges (X1) don't fold it.

Late rows go to a side table, one row a reason; what is in time for its window goes into partial
counts, which batches only add to. So for X4 rows in = rows counted + rows ``window_closed``, and for
X1 rows in = rows out + rows ``out_of_order``. Every table has a folder a batch, written whole: a batch
that runs again after a failure replaces what it wrote. A folder belongs to one checkpoint.

A row without arrival or number is never late for it; without arrival its window is null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.functions.scalars import message_size, point_count

KEYS = ("run_id", "topic")
CLOSED, OUT_OF_ORDER = "window_closed", "out_of_order"
SEEN, WINDOWS, LATE = "seen", "windows", "late"


def _watermark(seen: DataFrame, delay_us: int) -> int | None:
    """The greatest arrival less the delay (one number)."""
    known = seen.agg(F.max("last_us")).first()[0]
    return None if known is None else known - delay_us


def late_writer(path: str, seconds: int = 1, delay_us: int = 10_000_000, keys: Sequence[str] = KEYS) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` callback over a stream of messages."""
    path, width = path.rstrip("/"), int(seconds * 1_000_000)

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, "seq", "arrival_us", message_size().alias("size"), point_count().alias("points"))
        latest = rows.groupBy(*keys).agg(F.max("seq").alias("last_seq"), F.max("arrival_us").alias("last_us"))
        mark, closed, behind = None, F.lit(False), F.lit(False)
        if epoch_id:
            before = spark.read.schema(latest.schema).parquet(f"{path}/{SEEN}/batch={epoch_id - 1}")
            mark = _watermark(before, delay_us)
            rows = rows.join(before.select(*keys, F.col("last_seq").alias("_seq")), list(keys), "left")
            latest = before.unionByName(latest).groupBy(*keys).agg(F.max("last_seq").alias("last_seq"), F.max("last_us").alias("last_us"))
            behind = F.coalesce(F.col("seq") <= F.col("_seq"), F.lit(False))
        start = F.floor(F.col("arrival_us") / F.lit(width)).cast("long") * F.lit(width)
        rows = rows.withColumn("window_start_us", start)
        if mark is not None:
            closed = F.coalesce(F.col("window_start_us") + width <= F.lit(mark), F.lit(False))
        reasons = F.array_compact(F.array(F.when(closed, CLOSED), F.when(behind, OUT_OF_ORDER)))
        late = rows.select(*keys, "seq", "arrival_us", F.lit(mark).cast("long").alias("watermark_us"), F.explode(reasons).alias("reason"))
        counts = rows.where(~closed).groupBy(*keys, "window_start_us").agg(
            F.count(F.lit(1)).alias("messages"), F.sum("size").alias("bytes"), F.sum("points").alias("points")
        )
        for name, table in ((LATE, late), (WINDOWS, counts), (SEEN, latest)):
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch_id}")

    return write


def _batches(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{path.rstrip('/')}/{name}").parquet(f"{path.rstrip('/')}/{name}/batch=*")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The side table: keys, seq, arrival_us, reason, the batch that brought the row and the
    watermark it met (null in the first batch)."""
    return _batches(spark, path, LATE)


def window_counts(spark: SparkSession, path: str, seconds: int = 1, delay_us: int = 10_000_000, keys: Sequence[str] = KEYS) -> DataFrame:
    """X4 of the rows in time so far; ``closed`` once no later row can join the window."""
    mark = _watermark(_batches(spark, path, SEEN), delay_us)
    counts = _batches(spark, path, WINDOWS).groupBy(*keys, "window_start_us").agg(*[F.sum(c).alias(c) for c in ("messages", "bytes", "points")])
    ended = F.col("window_start_us") + int(seconds * 1_000_000) <= F.lit(mark).cast("long")
    return counts.withColumn("closed", F.coalesce(ended, F.lit(False)))
