"""Aggregations: run summaries, NaN-safe statistics, per-slot/per-process statistics,
histograms and cumulative checkpoints.

All are grouped aggregates (partial aggregation before the shuffle). Keys are bounded
(run, topic / host / series / slot); hot keys are handled by the map-side combine, since
every aggregate here is algebraic (count, sum, min, max, sum of squares).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.functions import rules

STREAM_KEYS = ("run_id", "topic")


def _kv(c: str, rounded: bool, places: int = 3) -> Column:
    """A published metric as the analyzer reads it back: missing → 0.0, text-rounded."""
    x = f"coalesce(CAST(`{c}` AS DOUBLE), 0D)"
    if not rounded:
        return F.expr(x)
    exact = float(1 << 53) / 10**places  # beyond it a double has no digit to round
    return F.expr(f"CASE WHEN isnan({x}) OR abs({x}) >= {exact!r}D THEN {x} ELSE floor({x} * 1e{places}D + 0.5D) / 1e{places}D END")


def population_std(col: Column) -> Column:
    """A2: population standard deviation, 0 for an empty input."""
    return F.coalesce(F.stddev_pop(col), F.lit(0.0))


def stream_summary(ticks: DataFrame, keys: Sequence[str] = STREAM_KEYS, rounded: bool = True) -> DataFrame:
    """A1: per (run, topic) summary of the published tick metrics."""
    hz, jit, bw = _kv("current_hz", rounded), _kv("jitter_ms", rounded), _kv("bandwidth_mbps", rounded)
    mps, mbps = _kv("messages_per_second", rounded), _kv("mbytes_per_second", rounded)
    kps, ppm = _kv("kpoints_per_second", rounded), _kv("avg_points_per_message", rounded)
    return ticks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(hz).alias("average_hz"),
        F.min(hz).alias("min_hz"),
        F.max(hz).alias("max_hz"),
        population_std(hz).alias("std_hz"),
        F.avg(jit).alias("average_ms"),
        F.min(jit).alias("min_ms"),
        F.max(jit).alias("max_ms"),
        population_std(jit).alias("std_ms"),
        F.avg(bw).alias("average_mbps"),
        F.min(bw).alias("min_mbps"),
        F.max(bw).alias("max_mbps"),
        F.avg(mps).alias("average_messages_per_sec"),
        F.avg(mbps).alias("average_mbytes_per_sec"),
        F.avg(kps).alias("average_kpoints_per_sec"),
        F.max(kps).alias("max_kpoints_per_sec"),
        F.coalesce(F.avg(F.when(ppm > 0, ppm)), F.lit(0.0)).alias("average_points_per_message"),
    )


def with_ratings(summary: DataFrame) -> DataFrame:
    """F7/F8/F9 on a stream summary (system block absent → its rules are skipped)."""
    has = F.col("samples") > 0
    return summary.select(
        "*",
        rules.performance_rating("average_hz", has).alias("performance_rating"),
        rules.stability_rating("average_ms", has).alias("stability_rating"),
        rules.recommendations("average_hz", "average_ms", "average_mbps").alias("recommendations"),
    )


# ---------------------------------------------------------------------------------------
# Series statistics (A5, A8, A12), cumulative checkpoints (W15, A6), slot statistics
# ---------------------------------------------------------------------------------------
SERIES_KEYS = ("run_id", "series")


def valid(v: Column) -> Column:
    """NULL for NaN, so aggregates skip it."""
    return F.nanvl(v, F.lit(None).cast("double"))


def nan_safe_stats(series: DataFrame, keys: Sequence[str] = SERIES_KEYS, value_col: str = "value") -> DataFrame:
    """A5: avg/min/max/pop-std ignoring NaN; all zeros when nothing valid is left."""
    v = valid(F.col(value_col))
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count(v).alias("valid"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg"),
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"),
    )


def series_stats(series: DataFrame, keys: Sequence[str] = SERIES_KEYS, value_col: str = "value") -> DataFrame:
    """avg/std/min/max on the full data with NaN propagating (any NaN → NaN)."""
    v = F.col(value_col)
    has_nan = F.max(F.isnan(v).cast("int")) > 0
    nan = F.lit(float("nan"))
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.when(has_nan, nan).otherwise(F.avg(v)).alias("avg"),
        F.when(has_nan, nan).otherwise(F.stddev_pop(v)).alias("std"),
        F.when(has_nan, nan).otherwise(F.min(v)).alias("min"),
        F.when(has_nan, nan).otherwise(F.max(v)).alias("max"),
    )


def std_band(stats_df: DataFrame) -> DataFrame:
    """P20: mean ± 1 std, only when std > 0."""
    pos = F.col("std") > 0
    return stats_df.withColumn("band_low", F.when(pos, F.col("avg") - F.col("std"))).withColumn(
        "band_high", F.when(pos, F.col("avg") + F.col("std"))
    )


def histogram(series: DataFrame, bins: int = 10, keys: Sequence[str] = SERIES_KEYS, value_col: str = "value") -> DataFrame:
    """Equal-width histogram of the valid values per series, bins 1..n over [min, max], empty
    ones too (the maximum falls in the last bin; equal values all fall in the first). Bounds come
    from a grouped aggregate; a series without valid values has no bins."""
    v = valid(F.col(value_col))
    clean = series.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    bounds = clean.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    j = clean.join(bounds, list(keys))
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(1).cast("long")).otherwise(
        F.least(F.lit(bins).cast("long"), F.floor((F.col("_v") - F.col("_lo")) * F.lit(float(bins)) / width).cast("long") + 1)
    )
    counts = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    grid = bounds.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"), "_lo", "_hi")
    full = grid.join(counts, [*keys, "bin"], "left")
    return full.select(*keys, "bin", F.coalesce("_n", F.lit(0)).alias("count"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))


PARTIALS = "bucket long, samples long, valid long, mean double, m2 double, min double, max double, last_us long"


def checkpoint_partials(
    series: DataFrame, interval_s: float, keys: Sequence[str] = SERIES_KEYS, runs: DataFrame | None = None, run_keys: Sequence[str] = SERIES_KEYS, value_col: str = "value"
) -> DataFrame:
    """Mergeable partials (``PARTIALS``) per interval of each series: number of samples and of valid
    ones, mean, sum of squared distances from that mean, minimum, maximum, last elapsed time. An
    interval holds the samples with (bucket - 1)·interval < elapsed <= bucket·interval, without
    those after the run's end if ``runs`` (``duration_s``) is given."""
    if runs is not None:
        series = series.join(_durations(runs, run_keys), list(run_keys)).where(F.col("elapsed_us") <= F.col("_dur_us"))
    v = valid(F.col(value_col))
    b = F.expr(f"CAST(ceil(elapsed_us / {int(round(interval_s * 1e6))}D) AS BIGINT)")
    return series.groupBy(*keys, b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count(v).alias("valid"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.max("elapsed_us").alias("last_us"),
    )


def _durations(runs: DataFrame, run_keys: Sequence[str]) -> DataFrame:
    return runs.select(*run_keys, (F.col("duration_s") * F.lit(1e6)).cast("long").alias("_dur_us"))


def cumulative_checkpoints(
    series: DataFrame,
    runs: DataFrame,
    interval_s: float,
    keys: Sequence[str] = SERIES_KEYS,
    run_keys: Sequence[str] = ("run_id", "series"),
    value_col: str = "value",
) -> DataFrame:
    """At every checkpoint k·interval (and once at the run end when the duration is not a
    multiple) statistics over all samples with elapsed <= the checkpoint, NaN skipped. Samples
    after the run's end belong to no checkpoint. ``runs`` gives ``duration_s`` per (run, series).

    Partials per interval first; see :func:`merged_checkpoints`."""
    return merged_checkpoints(checkpoint_partials(series, interval_s, keys, runs, run_keys, value_col), runs, interval_s, keys, run_keys)


def merged_checkpoints(
    parts: DataFrame, runs: DataFrame, interval_s: float, keys: Sequence[str] = SERIES_KEYS, run_keys: Sequence[str] = SERIES_KEYS
) -> DataFrame:
    """The cumulative checkpoints of W15 from partials (``PARTIALS``; any number of rows per series
    and interval, so those of several micro-batches merge).

    The variance is taken around the series' mean, so a large offset doesn't cancel it. The windows
    run over the partials only."""
    iv = int(round(interval_s * 1e6))
    dur = _durations(runs, run_keys)
    every = Window.partitionBy(*keys)
    finite = (F.col("valid") > 0) & (F.abs("mean") < float("inf"))
    n = F.when(finite, F.col("valid"))
    parts = parts.withColumn("_c", F.coalesce(F.sum(n * F.col("mean")).over(every) / F.sum(n).over(every), F.lit(0.0)))
    off = F.col("mean") - F.col("_c")
    parts = parts.select(
        *keys, "bucket", "_c", F.col("samples").alias("_cnt"), F.col("valid").alias("_n"), (F.col("valid") * off).alias("_s"),
        (F.col("m2") + F.col("valid") * off * off).alias("_s2"), F.col("min").alias("_mn"), F.col("max").alias("_mx"), F.col("last_us").alias("_last_us"),
    )
    n_full = F.expr(f"_dur_us div {iv}")
    grid = dur.select(
        *run_keys,
        "_dur_us",
        F.explode(
            F.when(F.expr(f"_dur_us % {iv}") == 0, F.sequence(F.lit(1).cast("long"), F.greatest(n_full, F.lit(1).cast("long"))))
            .otherwise(F.sequence(F.lit(1).cast("long"), n_full + 1))
        ).alias("checkpoint"),
    ).where(F.col("checkpoint") * iv <= F.col("_dur_us") + iv)
    grid = grid.withColumn("end_us", F.least(F.col("checkpoint") * iv, F.col("_dur_us"))).withColumn(
        "is_final", F.col("end_us") == F.col("_dur_us")
    )
    # cumulative partials at each checkpoint: union the grid into the bucket table and run
    # one window over (series) ordered by (bucket, grid-after-data)
    g = grid.select(*run_keys, F.col("checkpoint").alias("bucket"), "checkpoint", "end_us", "is_final")
    p = parts.select(*keys, "bucket", F.lit(None).cast("long").alias("checkpoint"), F.lit(None).cast("long").alias("end_us"),
                     F.lit(None).cast("boolean").alias("is_final"), "_c", "_cnt", "_n", "_s", "_s2", "_mn", "_mx", "_last_us")
    for c, t in (("_c", "double"), ("_cnt", "long"), ("_n", "long"), ("_s", "double"), ("_s2", "double"), ("_mn", "double"), ("_mx", "double"), ("_last_us", "long")):
        g = g.withColumn(c, F.lit(None).cast(t))
    u = p.unionByName(g)
    w = Window.partitionBy(*keys).orderBy("bucket", F.col("checkpoint").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    r = u.select(
        *keys,
        "checkpoint",
        "end_us",
        "is_final",
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("samples"),
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("valid"),
        F.sum("_s").over(w).alias("_cs"),
        F.sum("_s2").over(w).alias("_cs2"),
        F.min("_mn").over(w).alias("_cmn"),
        F.max("_mx").over(w).alias("_cmx"),
        F.max("_last_us").over(w).alias("last_elapsed_us"),
        F.last("_c", ignorenulls=True).over(w).alias("_c"),
    ).where(F.col("checkpoint").isNotNull())
    n = F.col("valid").cast("double")
    mean = F.col("_cs") / n
    var = F.greatest(F.col("_cs2") / n - mean * mean, F.lit(0.0))
    return r.select(
        *keys,
        "checkpoint",
        "end_us",
        "is_final",
        "samples",
        "valid",
        F.when(F.col("valid") > 0, F.col("_c") + mean).otherwise(F.lit(0.0)).alias("avg"),
        F.coalesce(F.col("_cmn"), F.lit(0.0)).alias("min"),
        F.coalesce(F.col("_cmx"), F.lit(0.0)).alias("max"),
        F.when(F.col("valid") > 0, F.sqrt(var)).otherwise(F.lit(0.0)).alias("std"),
        F.coalesce(F.col("last_elapsed_us"), F.lit(0)).alias("last_elapsed_us"),
    )


def checkpoint_report(checkpoints: DataFrame, roles: dict[str, str], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per (run, checkpoint) with the stats of the role series (hz, jitter, …)
    as structs, the long-run ratings (empty = 0 Hz → Poor, 0 ms → Excellent) and the
    recommendations. ``roles`` maps role → series name; a series may have several roles. The
    duration is the last elapsed time that any role's series has reached."""
    plays = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s).alias("of")) for r, s in sorted(roles.items())])
    c = checkpoints.withColumn("_r", F.explode(plays)).where(F.col("_r.of") == F.col("series")).withColumn("role", F.col("_r.role"))
    last = c.groupBy(*keys, "checkpoint").agg(F.max("last_elapsed_us").alias("_last"))
    stat = F.struct("samples", "valid", "avg", "min", "max", "std")
    wide = c.groupBy(*keys, "checkpoint", "end_us", "is_final").pivot("role", sorted(roles)).agg(F.first(stat))
    hz = F.coalesce(F.col("hz.avg"), F.lit(0.0)) if "hz" in roles else F.lit(0.0)
    jit = F.coalesce(F.col("jitter.avg"), F.lit(0.0)) if "jitter" in roles else F.lit(0.0)
    out = wide.join(last, [*keys, "checkpoint"]).withColumn("duration_s", F.col("_last").cast("double") / F.lit(1e6)).drop("_last")
    out = out.withColumn("label", F.format_string("Day%.1f", F.col("end_us").cast("double") / F.lit(86400e6)))
    out = out.withColumn("performance_rating", rules.performance_rating(hz)).withColumn("stability_rating", rules.stability_rating(jit))
    rec = rules.recommendations(
        hz,
        jit,
        F.col("bandwidth.avg") if "bandwidth" in roles else None,
        F.col("cpu.avg") if "cpu" in roles else None,
        F.col("memory.avg") if "memory" in roles else None,
    )
    return out.withColumn("recommendations", rec)


def process_slot_stats(slots: DataFrame, labels: DataFrame, keys: Sequence[str] = ("run_id", "slot")) -> DataFrame:
    """Per slot NaN-skipping avg/min/max of memory and CPU, with the latest labels; a slot
    with neither a name nor any valid value is dropped."""
    mem, cpu = valid(F.col("memory_mb")), valid(F.col("cpu_percent"))
    s = slots.groupBy(*keys).agg(
        F.count(mem).alias("memory_samples"),
        F.avg(mem).alias("memory_avg_mb"),
        F.min(mem).alias("memory_min_mb"),
        F.max(mem).alias("memory_max_mb"),
        F.count(cpu).alias("cpu_samples"),
        F.avg(cpu).alias("cpu_avg_percent"),
        F.min(cpu).alias("cpu_min_percent"),
        F.max(cpu).alias("cpu_max_percent"),
    )
    j = s.join(labels, list(keys), "left")
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    return j.where(named | (F.col("memory_samples") > 0) | (F.col("cpu_samples") > 0))
