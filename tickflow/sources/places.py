"""Text files cut at a separator, every piece with its place in its file, however the files are split.

A reader of lines gets its splits in any number of tasks, so a piece's place is known inside its
split only. Splits are told apart by file and byte offset; a table with one row a split carries what
the splits before hold (counts, or the state of a scan) into the next one. No task holds a file, and
every window is over one split (``spark.sql.files.maxPartitionBytes``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

SPLIT = ["_file", "_block"]
FILE_ROW_BITS = 40  # of a row id; the bits above name the file


def in_split() -> WindowSpec:
    return Window.partitionBy(*SPLIT).orderBy("_at")


def so_far() -> WindowSpec:
    """The pieces of the split up to this one."""
    return in_split().rowsBetween(Window.unboundedPreceding, 0)


def earlier() -> WindowSpec:
    """Over a table with a row a split: the splits before this one."""
    return Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def total_before(col: str) -> Column:
    return F.coalesce(F.sum(col).over(earlier()), F.lit(0))


def pieces(spark: SparkSession, path: str | list[str], sep: str = "\n") -> DataFrame:
    """(_file, _block, _at, value): the pieces between separators. ``_at`` orders the pieces of one
    split and means nothing beyond it."""
    meta = [F.input_file_name().alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    return spark.read.option("lineSep", sep).text(path).select(*meta, F.monotonically_increasing_id().alias("_at"), "value")


def carried(rows: DataFrame, ends: Sequence[Column], start: Sequence[Column]) -> DataFrame:
    """``rows`` with the columns ``start``: what the splits before hold, from one row a split with the
    aggregates ``ends`` (``start`` are windows over :func:`earlier`)."""
    table = rows.groupBy(*SPLIT).agg(*ends)
    return rows.join(table.select(*SPLIT, *start), SPLIT)


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """``rows`` of :func:`pieces` with their number in the file, from 0."""
    rows = carried(rows, [F.count(F.lit(1)).alias("_n")], [total_before("_n").alias("_from")])
    return rows.withColumn(name, F.col("_from") + F.row_number().over(in_split()) - 1).drop("_from")


def with_file_number(rows: DataFrame, name: str = "_no") -> DataFrame:
    """``rows`` with the number of their file in the order of names (one row a file is ranked). The
    table of files goes to the rows, which stay where they are."""
    files = rows.select("_file").distinct()
    return rows.join(F.broadcast(files.withColumn(name, F.row_number().over(Window.orderBy("_file")).cast("long") - 1)), "_file")
