"""Process and host-sample operators: top-N per sample, slot padding and pivoting, system
summaries and temperature statistics (W9, W10, P22, P23, A3, A4, A7b)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions.scalars import process_display_name, truncate_text
from tickflow.operators.windows import top_n_per_sample
from tickflow.schemas import TOP_SLOTS

HOST_KEYS = ("run_id", "host")
SAMPLE_KEYS = ("run_id", "host", "sample_seq")


def top_processes(procs: DataFrame, n: int = TOP_SLOTS) -> DataFrame:
    """W10 then the late columns (display name, 200-char command line, MB) for survivors only."""
    top = top_n_per_sample(procs, n, SAMPLE_KEYS)
    return top.select(
        *SAMPLE_KEYS,
        "rank",
        "pid",
        "name",
        process_display_name("name", "pid").alias("display_name"),
        (F.col("rss_bytes").cast("double") / F.lit(1048576.0)).alias("memory_mb"),
        "cpu_percent",
        truncate_text("cmdline").alias("cmdline"),
        "exe",
        "cwd",
    )


def pad_slots(top: DataFrame, n: int = TOP_SLOTS) -> DataFrame:
    """Exactly n slots per sample; missing slots are '' / pid 0 / 0.0 MB / 0.0 %.

    The slot grid comes from exploding ``sequence(1, n)`` per sample, taken from its rank-1 row
    (a generator, no distinct and no join with a separate range table), then a left join with
    the ranked rows."""
    # every sample with at least one process has exactly one rank-1 row: no distinct needed
    samples = top.where(F.col("rank") == 1).select(*SAMPLE_KEYS)
    grid = samples.select(*SAMPLE_KEYS, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    j = grid.join(top, [*SAMPLE_KEYS, "rank"], "left")
    return j.select(
        *SAMPLE_KEYS,
        "rank",
        F.coalesce(F.col("pid"), F.lit(0).cast("long")).alias("pid"),
        F.coalesce(F.col("name"), F.lit("")).alias("name"),
        F.coalesce(F.col("display_name"), F.lit("")).alias("display_name"),
        F.coalesce(F.col("memory_mb"), F.lit(0.0)).alias("memory_mb"),
        F.coalesce(F.col("cpu_percent"), F.lit(0.0)).alias("cpu_percent"),
        F.coalesce(F.col("cmdline"), F.lit("")).alias("cmdline"),
        F.coalesce(F.col("exe"), F.lit("")).alias("exe"),
        F.coalesce(F.col("cwd"), F.lit("")).alias("cwd"),
    )


def pivot_slots(padded: DataFrame, fields: Sequence[str] = ("memory_mb", "cpu_percent", "display_name"), n: int = TOP_SLOTS) -> DataFrame:
    """Long slot rows → wide ``top_process_{i}_{field}`` columns (one row per sample).
    Pivot values are listed, so no extra job discovers them."""
    aggs = [F.first(F.col(f)).alias(f) for f in fields]
    wide = padded.groupBy(*SAMPLE_KEYS).pivot("rank", list(range(1, n + 1))).agg(*aggs)
    rename = []
    for c in wide.columns:
        if c in SAMPLE_KEYS:
            rename.append(F.col(c))
        else:
            i, f = c.split("_", 1) if len(fields) > 1 else (c, fields[0])
            rename.append(F.col(f"`{c}`").alias(f"top_process_{i}_{f}"))
    return wide.select(*rename)


def unpivot_slots(wide: DataFrame, fields: Sequence[str] = ("memory_mb", "cpu_percent", "display_name"), n: int = TOP_SLOTS) -> DataFrame:
    """P23 inverse: wide slot columns → one row per (sample, slot)."""
    items = [
        F.struct(F.lit(i).alias("rank"), *[F.col(f"top_process_{i}_{f}").alias(f) for f in fields]) for i in range(1, n + 1)
    ]
    return wide.select(*SAMPLE_KEYS, F.explode(F.array(*items)).alias("_s")).select(*SAMPLE_KEYS, "_s.*")


def process_stats(procs: DataFrame) -> DataFrame:
    """Statistics keyed by process (run, host, pid, name), not by rank slot."""
    mb = F.col("rss_bytes").cast("double") / F.lit(1048576.0)
    return procs.groupBy(*HOST_KEYS, "pid", "name").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(mb).alias("avg_memory_mb"),
        F.max(mb).alias("max_memory_mb"),
        F.min(mb).alias("min_memory_mb"),
        F.avg("cpu_percent").alias("avg_cpu_percent"),
        F.max("cpu_percent").alias("max_cpu_percent"),
        F.min("cpu_percent").alias("min_cpu_percent"),
    )


def system_summary(samples: DataFrame, keys: Sequence[str] = HOST_KEYS) -> DataFrame:
    """A3: sample count and CPU / memory avg, max, min (missing → 0)."""
    cpu = F.coalesce(F.col("cpu_percent"), F.lit(0.0))
    mem = F.coalesce(F.col("memory_percent"), F.lit(0.0))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(cpu).alias("cpu_average_percent"),
        F.max(cpu).alias("cpu_max_percent"),
        F.min(cpu).alias("cpu_min_percent"),
        F.avg(mem).alias("memory_average_percent"),
        F.max(mem).alias("memory_max_percent"),
        F.min(mem).alias("memory_min_percent"),
    )


def temperature_summary(samples: DataFrame, temp_col: str = "cpu_temp_c", keys: Sequence[str] = HOST_KEYS) -> DataFrame:
    """A4: avg/max/min of the CPU temperature over values > 0 only (and their number); no row
    when none."""
    t = samples.where(F.col(temp_col) > 0)
    return t.groupBy(*keys).agg(
        F.count(temp_col).alias("samples"),
        F.avg(temp_col).alias("temperature_average_celsius"),
        F.max(temp_col).alias("temperature_max_celsius"),
        F.min(temp_col).alias("temperature_min_celsius"),
    )


def zone_summary(zone_long: DataFrame, keys: Sequence[str] = HOST_KEYS) -> DataFrame:
    """A4: per discovered zone avg/max/min over all its values (and their number). Input: (keys,
    zone, celsius)."""
    return zone_long.groupBy(*keys, "zone").agg(
        F.count("celsius").alias("samples"),
        F.avg("celsius").alias("average_celsius"),
        F.max("celsius").alias("max_celsius"),
        F.min("celsius").alias("min_celsius"),
    )
