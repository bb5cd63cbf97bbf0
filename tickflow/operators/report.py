"""Run report assembly and the report tables.

The report is a flat row per (run, topic) — stream summary joined with the run's host
summary — from which the nested report struct and the tables are projections (``stack`` /
``explode`` of literal arrays, no driver-side assembly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.functions import rules
from tickflow.functions.scalars import fixed_text, format_value, truncate_text
from tickflow.schemas import CMDLINE_MAX_CHARS, METRICS_TABLE_ROWS, PROCESS_TABLE_COLUMNS, RATING_NO_DATA, TEXT_SUMMARY_TITLE

KEYS = ("run_id", "topic")


def build_report(
    stream: DataFrame,
    system: DataFrame | None,
    runs: DataFrame,
    temperature: DataFrame | None = None,
    zones: DataFrame | None = None,
) -> DataFrame:
    """Stream summary (A1) + host summary (A3) + temperature (A4) + ratings (F7, F8) +
    recommendations (F9) + start / end / configured duration, one row per (run, topic).

    ``system`` / ``temperature`` / ``zones`` have a row per host (and zone); a run's hosts are
    taken together first: averages weighted by samples, largest and smallest values. Missing
    blocks stay NULL and their recommendation rules are skipped."""
    r = stream.join(runs.select(*KEYS, "start_us", "duration_s"), list(KEYS), "left")
    if system is not None:
        r = r.join(_over_hosts(system, ["run_id"]).withColumnRenamed("samples", "system_samples"), "run_id", "left")
    if temperature is not None:
        r = r.join(_over_hosts(temperature, ["run_id"]).drop("samples"), "run_id", "left")
    if zones is not None:
        zmap = _over_hosts(zones, ["run_id", "zone"]).groupBy("run_id").agg(
            F.map_from_entries(
                F.collect_list(F.struct("zone", F.struct("average_celsius", "max_celsius", "min_celsius")))
            ).alias("jetson_temperatures")
        )
        r = r.join(zmap, "run_id", "left")
    has = F.col("samples") > 0
    cpu = F.col("cpu_average_percent") if system is not None else None
    mem = F.col("memory_average_percent") if system is not None else None
    return r.select(
        *[c for c in r.columns if c != "duration_s"],
        F.col("duration_s").alias("duration_seconds"),
        rules.performance_rating("average_hz", has).alias("performance_rating"),
        rules.stability_rating("average_ms", has).alias("stability_rating"),
        rules.recommendations("average_hz", "average_ms", "average_mbps", cpu, mem).alias("recommendations"),
        F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros(F.col("start_us") + (F.col("duration_s") * F.lit(1e6)).cast("long")).alias("end_time"),
    )


def _over_hosts(summary: DataFrame, keys: list[str]) -> DataFrame:
    """One row per `keys` from a summary per host: its ``samples`` add up and weigh the averages."""
    total = F.sum("samples")
    out = []
    for c in summary.columns:
        if "average" in c:
            out.append((F.sum(F.col(c) * F.col("samples")) / total).alias(c))
        elif "max" in c or "min" in c:
            out.append((F.max(c) if "max" in c else F.min(c)).alias(c))
    return summary.groupBy(*keys).agg(total.alias("samples"), *out)


def nested_report(report: DataFrame) -> DataFrame:
    """D7 shape of :func:`build_report` rows (for the JSON sink)."""
    cols = set(report.columns)
    metrics = F.struct(
        F.col("samples").alias("samples"),
        F.struct(F.col("average_hz"), F.col("min_hz"), F.col("max_hz"), F.col("std_hz")).alias("frequency"),
        F.struct(F.col("average_ms"), F.col("min_ms"), F.col("max_ms"), F.col("std_ms")).alias("jitter"),
        F.struct(F.col("average_mbps"), F.col("min_mbps"), F.col("max_mbps")).alias("bandwidth"),
        F.struct(
            "average_messages_per_sec", "average_mbytes_per_sec", "average_kpoints_per_sec", "max_kpoints_per_sec",
            "average_points_per_message",
        ).alias("throughput"),
    )
    system_parts = []
    if "system_samples" in cols:
        system_parts += [
            F.col("system_samples").alias("samples"),
            F.struct(
                F.col("cpu_average_percent").alias("average_percent"),
                F.col("cpu_max_percent").alias("max_percent"),
                F.col("cpu_min_percent").alias("min_percent"),
            ).alias("cpu"),
            F.struct(
                F.col("memory_average_percent").alias("average_percent"),
                F.col("memory_max_percent").alias("max_percent"),
                F.col("memory_min_percent").alias("min_percent"),
            ).alias("memory"),
        ]
    if "temperature_average_celsius" in cols:
        system_parts.append(
            F.when(
                F.col("temperature_average_celsius").isNotNull(),
                F.struct(
                    F.col("temperature_average_celsius").alias("average_celsius"),
                    F.col("temperature_max_celsius").alias("max_celsius"),
                    F.col("temperature_min_celsius").alias("min_celsius"),
                ),
            ).alias("temperature")
        )
    if "jetson_temperatures" in cols:
        system_parts.append(F.col("jetson_temperatures"))
    out = [
        *KEYS,
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"),
        F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("end_time"),
        "duration_seconds",
        metrics.alias("metrics"),
    ]
    if system_parts:
        out.append(F.struct(*system_parts).alias("system_stats"))
    out.append(F.struct("performance_rating", "stability_rating", "recommendations").alias("summary"))
    return report.select(*out)


def _stack(report: DataFrame, keys: Sequence[str], rows: list[tuple], names: Sequence[str]) -> DataFrame:
    """Literal array of structs exploded per report row (a per-row generator, no join)."""
    items = []
    for i, row in enumerate(rows):
        fields = [F.lit(i).alias("ord")]
        for name, val in zip(names, row):
            fields.append((val if isinstance(val, Column) else F.lit(val)).alias(name))
        items.append(F.struct(*fields))
    return report.select(*keys, F.explode(F.array(*items)).alias("_r")).select(*keys, "_r.*")


def metrics_overview(report: DataFrame) -> DataFrame:
    """The five overview bars (label, value), missing → 0."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = [
        ("Avg Hz", z("average_hz")),
        ("Avg Jitter (ms)", z("average_ms")),
        ("Avg BW (Mbps)", z("average_mbps")),
        ("Avg Throughput (Kpts/s)", z("average_kpoints_per_sec")),
        ("Messages/sec", z("average_messages_per_sec")),
    ]
    return _stack(report, KEYS, rows, ["label", "value"])


def used_available(report: DataFrame) -> DataFrame:
    """Percent used → (used, 100 − used) for CPU and memory."""
    rows = [
        ("CPU", F.col("cpu_average_percent"), F.lit(100.0) - F.col("cpu_average_percent")),
        ("Memory", F.col("memory_average_percent"), F.lit(100.0) - F.col("memory_average_percent")),
    ]
    return _stack(report, KEYS, rows, ["resource", "used", "available"])


def summary_table(report: DataFrame) -> DataFrame:
    """A16 (metric part): metric × average/min/max/std; throughput has no min and no std,
    bandwidth no std."""
    null = F.lit(None).cast("double")
    rows = [
        ("Frequency (Hz)", F.col("average_hz"), F.col("min_hz"), F.col("max_hz"), F.col("std_hz")),
        ("Jitter (ms)", F.col("average_ms"), F.col("min_ms"), F.col("max_ms"), F.col("std_ms")),
        ("Bandwidth (Mbps)", F.col("average_mbps"), F.col("min_mbps"), F.col("max_mbps"), null),
        ("Throughput (K pts/s)", F.col("average_kpoints_per_sec"), null, F.col("max_kpoints_per_sec"), null),
    ]
    return _stack(report, KEYS, rows, ["metric", "average", "min", "max", "std"])


def run_info_table(report: DataFrame) -> DataFrame:
    """A16 (run part): five label / value text rows."""
    rows = [
        ("Test Start Time", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss")),
        ("Test End Time", F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss")),
        ("Duration (seconds)", F.col("duration_seconds").cast("string")),
        ("Performance Rating", F.coalesce(F.col("performance_rating"), F.lit("N/A"))),
        ("Stability Rating", F.coalesce(F.col("stability_rating"), F.lit("N/A"))),
    ]
    return _stack(report, KEYS, rows, ["label", "value"])


def metrics_table(report: DataFrame) -> DataFrame:
    """The 17 real (metric, value, unit) rows; missing throughput → 0."""
    rows = [(m, F.coalesce(F.col(c).cast("double"), F.lit(0.0)), u) for m, c, u in METRICS_TABLE_ROWS]
    return _stack(report, KEYS, rows, ["metric", "value", "unit"])


def system_table(report: DataFrame) -> DataFrame:
    """CPU, memory, temperature (when present), one row per zone (upper-cased), samples; one
    array per report row, exploded once."""

    def row(ord_: int, resource, *values) -> Column:
        cells = zip(("average", "min", "max"), [v.cast("double") for v in values])
        return F.struct(F.lit(ord_).alias("ord"), resource.alias("resource"), *[v.alias(n) for n, v in cells])

    null = F.lit(None)
    blocks = [("CPU Usage (%)", "cpu", "percent"), ("Memory Usage (%)", "memory", "percent"), ("CPU Temperature (°C)", "temperature", "celsius")]
    base = [row(i, F.lit(label), *[F.col(f"{what}_{f}_{unit}") for f in ("average", "min", "max")]) for i, (label, what, unit) in enumerate(blocks)]
    zones = F.map_entries(F.coalesce("jetson_temperatures", F.create_map().cast(report.schema["jetson_temperatures"].dataType)))
    items = F.concat(
        F.filter(F.array(*base), lambda r: r["average"].isNotNull()),
        F.transform(zones, lambda z: row(100, F.upper(z["key"]), z["value"]["average_celsius"], z["value"]["min_celsius"], z["value"]["max_celsius"])),
        F.array(row(200, F.lit("Total Samples"), F.col("system_samples"), null, null)),
    )
    return report.select(*KEYS, F.explode(items).alias("_r")).select(*KEYS, "_r.*")


def top_process_table(slot_stats: DataFrame, keys: Sequence[str] = ("run_id", "host", "slot")) -> DataFrame:
    """The per-slot statistics as display columns: ``N/A`` where nothing valid was measured,
    unnamed slots as ``Process i (no name)``, the command line cut for display."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = F.concat(F.lit("Process "), (F.col("slot") + 1).cast("string"))
    values = [PROCESS_TABLE_COLUMNS[5:8], PROCESS_TABLE_COLUMNS[8:]]
    stats = [format_value(f"{what}_{f}", 2).alias(c) for cols, (what, unit) in zip(values, (("memory", "mb"), ("cpu", "percent"))) for c, f in zip(cols, (f"avg_{unit}", f"min_{unit}", f"max_{unit}"))]
    made = [number, F.when(F.trim(text("name")) == "", F.concat(number, F.lit(" (no name)"))).otherwise(F.col("name")), truncate_text(text("cmdline"), CMDLINE_MAX_CHARS), text("exe"), text("cwd")]
    return slot_stats.select(*keys, *[c.alias(n) for c, n in zip(made, PROCESS_TABLE_COLUMNS)], *stats)


def performance_targets(report: DataFrame, spec_kpoints_per_sec: float | None = None) -> DataFrame:
    """documented targets per metric → good / acceptable / needs improvement."""
    rows = [
        ("frequency_hz", F.col("average_hz"), rules.target_band("average_hz", good_above=10, poor_below=5)),
        ("jitter_ms", F.col("average_ms"), rules.target_band("average_ms", good_below=25, poor_above=50)),
        ("cpu_percent", F.col("cpu_average_percent"), rules.target_band("cpu_average_percent", good_below=70, poor_above=80)),
        ("temperature_c", F.col("temperature_average_celsius"),
         rules.target_band("temperature_average_celsius", good_below=70, poor_above=80)),
    ]
    if spec_kpoints_per_sec:
        pct = F.col("average_kpoints_per_sec") / F.lit(float(spec_kpoints_per_sec)) * F.lit(100.0)
        rows.append(("throughput_pct_of_spec", pct, rules.target_band(pct, good_above=80, poor_below=50)))
    return _stack(report, KEYS, rows, ["metric", "value", "band"])


def run_metadata(report: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Timestamp, duration, both ratings (``N/A`` default) and the number of outputs, given
    as rows (run_id, topic, output) of whatever was written for the report."""
    out = report.select(
        *KEYS,
        F.date_format("end_time", "yyyyMMdd_HHmmss").alias("timestamp"),
        "duration_seconds",
        F.coalesce("performance_rating", F.lit("N/A")).alias("performance_rating"),
        F.coalesce("stability_rating", F.lit("N/A")).alias("stability_rating"),
    )
    if outputs is not None:
        counts = outputs.groupBy(*KEYS).agg(F.countDistinct("output").alias("outputs"))
        out = out.join(counts, list(KEYS), "left").withColumn("outputs", F.coalesce("outputs", F.lit(0)))
    return out


def rating_colours(report: DataFrame) -> DataFrame:
    """colour per rating for the two rating bars."""
    rows = [("Performance", F.col("performance_rating")), ("Stability", F.col("stability_rating"))]
    s = _stack(report, KEYS, rows, ["category", "rating"])
    return s.withColumn("colour", rules.rating_palette("rating"))


def report_lines(nested: DataFrame) -> DataFrame:
    """Pretty JSON of each report, one row per line."""
    js = F.to_json(F.struct(*[c for c in nested.columns if c not in KEYS]), {"pretty": "true"})
    return nested.select(*KEYS, F.posexplode(F.split(js, "\n")).alias("line_no", "line"))


def text_summary(report: DataFrame) -> DataFrame:
    """The console summary block per report: averages, ranges, throughput, host averages (when
    the report has them), ratings, advice."""

    def line(label: str, *parts) -> Column:
        return F.concat(F.lit(f"  {label}: "), *[fixed_text(*p) if isinstance(p, tuple) else F.lit(p) for p in parts])

    has = F.col("cpu_average_percent").isNotNull() if "cpu_average_percent" in report.columns else F.lit(False)
    host = [F.lit("System Resources:"), line("CPU Average", ("cpu_average_percent", 1), "%"), line("Memory Average", ("memory_average_percent", 1), "%")]
    lines = [
        F.lit("=" * 60),
        F.lit(TEXT_SUMMARY_TITLE),
        F.lit("=" * 60),
        F.lit("Frequency Performance:"),
        line("Average", ("average_hz", 2), " Hz"),
        line("Range", ("min_hz", 2), " - ", ("max_hz", 2), " Hz"),
        F.lit("Jitter Analysis:"),
        line("Average", ("average_ms", 2), " ms"),
        line("Range", ("min_ms", 2), " - ", ("max_ms", 2), " ms"),
        F.lit("Bandwidth Usage:"),
        line("Average", ("average_mbps", 2), " Mbps"),
        F.lit("Throughput Performance:"),
        line("Messages/sec", ("average_messages_per_sec", 2)),
        line("MB/sec", ("average_mbytes_per_sec", 2)),
        line("Points/sec", ("average_kpoints_per_sec", 2), "K"),
        line("Points/message", ("average_points_per_message", 0)),
        *([F.when(has, h) for h in host] if "cpu_average_percent" in report.columns else []),
        F.lit("Overall Ratings:"),
        F.concat(F.lit("  Performance: "), F.coalesce("performance_rating", F.lit(RATING_NO_DATA))),
        F.concat(F.lit("  Stability: "), F.coalesce("stability_rating", F.lit(RATING_NO_DATA))),
        F.lit("Recommendations:"),
        F.array_join(F.transform("recommendations", lambda r: F.concat(F.lit("  - "), r)), "\n"),
        F.lit("=" * 60),
    ]
    return report.select(*KEYS, F.concat_ws("\n", *lines).alias("text"))
