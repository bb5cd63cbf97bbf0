"""Daily health checks over thermal CSV rows and journal lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.schemas import BOOT_EVENT_PATTERN, HEALTH_VERDICT_PATTERNS, LOG_FAILURE_PATTERNS


def _contains_any(col: str, patterns: list[str]) -> F.Column:
    low = F.lower(F.col(col))
    out = F.lit(False)
    for p in patterns:
        out = out | low.contains(p.lower())
    return out


def thermal_clock_summary(csv: DataFrame) -> DataFrame:
    """A10: per day avg/max temperature and ARM clock; the maximum starts at 0 (an all-negative
    day reports 0). Days without rows do not appear (reported as ``no data`` by the caller)."""
    return csv.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("temp_c").alias("avg_temp_c"),
        F.greatest(F.max("temp_c"), F.lit(0.0)).alias("max_temp_c"),
        F.avg("arm_hz").alias("avg_arm_hz"),
        F.greatest(F.max("arm_hz"), F.lit(0.0)).alias("max_arm_hz"),
    )


def thermal_day_status(expected_days: DataFrame, csv: DataFrame) -> DataFrame:
    """A10 per expected day: the summary when the day has rows, else status ``no data``
    (a day whose file is missing is reported by the reader as ``no CSV``)."""
    summary = thermal_clock_summary(csv)
    j = expected_days.select("day").distinct().join(summary, "day", "left")
    return j.select(
        "day",
        F.when(F.col("rows").isNull(), F.lit("no data")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"),
        "avg_temp_c",
        "max_temp_c",
    )


def log_pattern_report(logs: DataFrame, patterns: list[str] = LOG_FAILURE_PATTERNS) -> DataFrame:
    """Per day and failure pattern, the number of lines containing it (any case).
    The pattern list is a literal array exploded per line, so the work is one pass plus a
    grouped count."""
    pats = F.array(*[F.lit(p) for p in patterns])
    low = F.lower(F.col("line"))
    hits = F.filter(pats, lambda p: low.contains(F.lower(p)))
    return logs.select("day", F.explode(hits).alias("pattern")).groupBy("day", "pattern").agg(F.count(F.lit(1)).alias("lines"))


def log_severity(logs: DataFrame, since_us: int) -> DataFrame:
    """journal lines with priority 0..3 at or after ``since_us``."""
    return logs.where(F.col("priority").between(0, 3) & (F.col("ts_us") >= since_us))


def boot_events(logs: DataFrame, n: int = 20) -> DataFrame:
    """the newest n lines mentioning a reboot or shutdown (top-k is the feature)."""
    hit = F.lower(F.col("line")).rlike(BOOT_EVENT_PATTERN)
    return logs.where(hit).orderBy(F.col("ts_us").desc(), F.col("line_no").desc()).limit(n)


def health_verdict(logs: DataFrame) -> DataFrame:
    """a day is unhealthy when any line of its report has one of the narrower words."""
    bad = _contains_any("line", HEALTH_VERDICT_PATTERNS)
    return logs.groupBy("day").agg(
        F.max(bad.cast("int")).cast("boolean").alias("unhealthy"), F.sum(bad.cast("int")).alias("bad_lines")
    )
