"""Sinks (S8-S12). All writes go to shared storage paths (the cluster's checkpoint folder for
intermediate tables); none passes data through the driver."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> bool:
    """A new version of a whole table: written to a folder of its own, then named in the version log,
    which a reader asks for the newest one. So a reader sees the old table or the new one, never a
    part, and a write that fails changes nothing it sees. The plan runs once; an empty table is
    written but not named, and goes again (False). Of the versions before, the last one stays for its readers."""
    spark, path, version = df.sparkSession, path.rstrip("/"), time.time_ns()
    folder = f"{path}/version-{version}"
    try:
        df.write.partitionBy(*partition_by).format(fmt).save(folder)
        published = bool(spark.read.schema(df.schema).format(fmt).load(folder).head(1))
    except Exception:
        _remove(spark, folder)
        raise
    if not published:
        _remove(spark, folder)
        return False
    older = _versions(spark, path)
    spark.createDataFrame([(version,)], VERSION).write.mode("append").parquet(f"{path}/{VERSIONS}")
    for v in older[:-1]:
        _remove(spark, f"{path}/version-{v}")
    return True


def read_snapshot(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The newest version written by :func:`write_snapshot`; no rows before the first."""
    versions = _versions(spark, path.rstrip("/"))
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(f"{path.rstrip('/')}/version-{versions[-1]}")


VERSIONS, VERSION = "_versions", "version long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The named versions that are still there, oldest first (two or three)."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{VERSIONS}")
    fs = log.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(log):
        return []
    newest = spark.read.schema(VERSION).parquet(f"{path}/{VERSIONS}").orderBy(F.col("version").desc()).limit(3).collect()
    return sorted(r["version"] for r in newest)


def _remove(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def write_series_snapshot(series: DataFrame, path: str) -> bool:
    """The whole current series as a new snapshot, not published while it is empty.

    Written as JSON lines partitioned by run (one row per sample), not as one document per
    run: a whole run in one document would pass an unbounded group through one task."""
    return write_snapshot(series, path, "json", ["run_id"])


def write_checkpoints(checkpoints: DataFrame, path: str) -> bool:
    """One folder per (run, checkpoint). Other checkpoints' folders are never touched; writing
    a checkpoint again (a retry) replaces its own, so no row doubles. An empty input adds no
    folder."""
    checkpoints.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "checkpoint").parquet(path)
    return True


def write_report(nested_report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports as JSON (nested struct as produced by ``report.nested_report``)."""
    nested_report.write.mode(mode).json(path)


def write_report_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """Each report table to ``path/<name>`` in a tabular format (parquet, csv, json)."""
    written = []
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(f"{path.rstrip('/')}/{name}")
        written.append(name)
    return written


def write_in_order(points: DataFrame, path: str, order: Sequence[str] = ("run_id", "series", "idx"), parts: int = 8) -> None:
    """T4: rows in a total order over ``parts`` tasks: ranges of ``order``, each sorted, in files whose
    names are in that order too. A long series is cut into several ranges. (Rows equal in all of
    ``order`` share a range; names sort up to 100,000 files.)"""
    points.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_in_order(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of :func:`write_in_order` with ``row_no``, their place over all files, from 0. Files are
    numbered by a table with one row a file."""
    rows = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    files = files.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    return rows.join(F.broadcast(files), "_file").withColumn("row_no", F.col("_from") + F.col("_row")).drop("_file", "_row", "_from")


def relay_restamp(msgs: DataFrame, keys=("run_id", "topic")) -> DataFrame:
    """Forward each message with a new stamp (now) and its interval to the previous one
    (W1 over the dense arrival index, so a hot topic is not one task)."""
    from tickflow.operators.windows import inter_arrival

    iv = inter_arrival(msgs, keys).select(*keys, "seq", "interval_us")
    return msgs.join(iv, [*keys, "seq"], "left").withColumn("stamp", F.current_timestamp())
