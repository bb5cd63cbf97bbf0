"""Entry point A end / C: the run report and its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.functions.scalars import format_value
from tickflow.operators import diagnostics, processes, report, stats, ticks
from tickflow.plans import oracle as O
from tickflow.plans.host_queries import _SENSOR_MEAN_SQL, _ZONE_MEAN_SQL, _cpu_temp
from tickflow.plans.registry import ORACLES, query, round_doubles, sql_fixed
from tickflow.plans.series_queries import _SLOTS_SQL, _slot_inputs
from tickflow.schemas import PROCESS_TABLE_COLUMNS, STREAM_KV_METRICS
from tickflow.session import per_session
from tickflow.sources import fixtures as fx
from tickflow.sources import sinks

K = ["run_id", "topic"]


@per_session
def _report(spark, sf, with_zones: bool = False):
    t = ticks.tick_metrics(fx.messages(spark, sf), fx.runs(spark, sf), with_min_max=False)
    stream = stats.stream_summary(t)
    samples = fx.system_samples(spark, sf)
    system = processes.system_summary(samples)
    temp = processes.temperature_summary(samples.withColumn("cpu_temp_c", _cpu_temp()))
    zones = None
    if with_zones:
        zs = F.array(*[F.struct(F.lit(c.split("_")[1]).alias("zone"), (F.col(c) / F.lit(1000.0)).alias("celsius")) for c in fx.ZONE_COLS])
        long = samples.select("run_id", "host", F.explode(zs).alias("z")).select("run_id", "host", "z.*").where(F.col("celsius").isNotNull())
        zones = processes.zone_summary(long)
    return report.build_report(stream, system, fx.runs(spark, sf), temp, zones)


REPORT_CTE = f"""sys AS (
  SELECT run_id, count(*) AS system_samples,
    avg(coalesce(cpu_percent, 0)) AS cpu_average_percent, max(coalesce(cpu_percent, 0)) AS cpu_max_percent,
    min(coalesce(cpu_percent, 0)) AS cpu_min_percent, avg(coalesce(memory_percent, 0)) AS memory_average_percent,
    max(coalesce(memory_percent, 0)) AS memory_max_percent, min(coalesce(memory_percent, 0)) AS memory_min_percent
  FROM system_samples GROUP BY run_id),
temp AS (
  SELECT run_id, avg(t) AS temperature_average_celsius, max(t) AS temperature_max_celsius, min(t) AS temperature_min_celsius
  FROM (SELECT run_id, coalesce({_ZONE_MEAN_SQL}, {_SENSOR_MEAN_SQL}) AS t FROM system_samples) WHERE t > 0 GROUP BY run_id),
report AS (
  SELECT s.*, r.duration_s AS duration_seconds, sys.system_samples, sys.cpu_average_percent, sys.cpu_max_percent, sys.cpu_min_percent,
    sys.memory_average_percent, sys.memory_max_percent, sys.memory_min_percent,
    temp.temperature_average_celsius, temp.temperature_max_celsius, temp.temperature_min_celsius,
    CASE WHEN s.samples = 0 THEN 'No data' WHEN s.average_hz >= 20 THEN 'Excellent' WHEN s.average_hz >= 10 THEN 'Good'
         WHEN s.average_hz >= 5 THEN 'Fair' ELSE 'Poor' END AS performance_rating,
    CASE WHEN s.samples = 0 THEN 'No data' WHEN s.average_ms <= 10 THEN 'Excellent' WHEN s.average_ms <= 25 THEN 'Good'
         WHEN s.average_ms <= 50 THEN 'Fair' ELSE 'Poor' END AS stability_rating,
    coalesce(nullif(array_to_string(list_filter([
      CASE WHEN s.average_hz < 10 THEN 'Consider optimizing point cloud processing to improve frequency' END,
      CASE WHEN s.average_ms > 50 THEN 'High jitter detected - check for system load or network issues' END,
      CASE WHEN s.average_mbps > 100 THEN 'High bandwidth usage - consider data compression or reduced resolution' END,
      CASE WHEN sys.cpu_average_percent > 80 THEN 'High CPU usage - consider performance optimization or hardware upgrade' END,
      CASE WHEN sys.memory_average_percent > 80 THEN 'High memory usage - check for memory leaks or increase system RAM' END],
      lambda x: x IS NOT NULL), '; '), ''), 'System performing within normal parameters') AS recommendations
  FROM stream_summary s JOIN runs r USING (run_id, topic) LEFT JOIN sys USING (run_id) LEFT JOIN temp USING (run_id))"""


def _rsql(body: str) -> str:
    return O.with_ctes(*O.STREAM_CTES, O.STREAM_SUMMARY, O.SYSTEM_SAMPLES, REPORT_CTE, body=body)


_REPORT_COLS = [
    "samples", "average_hz", "min_hz", "max_hz", "std_hz", "average_ms", "min_ms", "max_ms", "std_ms", "average_mbps",
    "min_mbps", "max_mbps", "average_messages_per_sec", "average_mbytes_per_sec", "average_kpoints_per_sec",
    "max_kpoints_per_sec", "average_points_per_message", "duration_seconds", "system_samples", "cpu_average_percent",
    "cpu_max_percent", "cpu_min_percent", "memory_average_percent", "memory_max_percent", "memory_min_percent",
    "temperature_average_celsius", "temperature_max_celsius", "temperature_min_celsius", "performance_rating",
    "stability_rating", "recommendations",
]
_INT_COLS = {"samples", "system_samples", "performance_rating", "stability_rating", "recommendations"}


@query(
    "build_report",
    _rsql(
        "SELECT run_id, topic, "
        + ", ".join(c if c in _INT_COLS else f"round({c}, 6) AS {c}" for c in _REPORT_COLS)
        + " FROM report"
    ),
)
def q_build_report(spark, sf):
    r = _report(spark, sf).withColumn("recommendations", F.array_join("recommendations", "; "))
    return round_doubles(r.select(*K, *_REPORT_COLS))


@query(
    "metrics_overview",
    _rsql(
        """SELECT run_id, topic, ord, label, round(value, 6) AS value FROM report, LATERAL (
  SELECT unnest([0, 1, 2, 3, 4]) AS ord,
         unnest(['Avg Hz', 'Avg Jitter (ms)', 'Avg BW (Mbps)', 'Avg Throughput (Kpts/s)', 'Messages/sec']) AS label,
         unnest([coalesce(average_hz, 0), coalesce(average_ms, 0), coalesce(average_mbps, 0), coalesce(average_kpoints_per_sec, 0),
                 coalesce(average_messages_per_sec, 0)]) AS value)"""
    ),
)
def q_metrics_overview(spark, sf):
    return round_doubles(report.metrics_overview(_report(spark, sf)))


@query(
    "used_available",
    _rsql(
        """SELECT run_id, topic, ord, resource, round(used, 6) AS used, round(available, 6) AS available FROM report, LATERAL (
  SELECT unnest([0, 1]) AS ord, unnest(['CPU', 'Memory']) AS resource,
         unnest([cpu_average_percent, memory_average_percent]) AS used,
         unnest([100e0 - cpu_average_percent, 100e0 - memory_average_percent]) AS available)"""
    ),
)
def q_used_available(spark, sf):
    return round_doubles(report.used_available(_report(spark, sf)))


@query(
    "summary_table",
    _rsql(
        """SELECT run_id, topic, ord, metric, round(average, 6) AS average, round("min", 6) AS "min", round("max", 6) AS "max", round(std, 6) AS std
FROM report, LATERAL (
  SELECT unnest([0, 1, 2, 3]) AS ord,
         unnest(['Frequency (Hz)', 'Jitter (ms)', 'Bandwidth (Mbps)', 'Throughput (K pts/s)']) AS metric,
         unnest([average_hz, average_ms, average_mbps, average_kpoints_per_sec]) AS average,
         unnest([min_hz, min_ms, min_mbps, NULL]) AS "min",
         unnest([max_hz, max_ms, max_mbps, max_kpoints_per_sec]) AS "max",
         unnest([std_hz, std_ms, NULL, NULL]) AS std)"""
    ),
)
def q_summary_table(spark, sf):
    return round_doubles(report.summary_table(_report(spark, sf)))


_MT = report.METRICS_TABLE_ROWS


@query(
    "metrics_table",
    _rsql(
        "SELECT run_id, topic, ord, metric, round(value, 6) AS value, unit FROM report, LATERAL (SELECT "
        + f"CAST(unnest(range(0, {len(_MT)})) AS INTEGER) AS ord, "
        + "unnest([" + ", ".join(f"'{m}'" for m, _, _ in _MT) + "]) AS metric, "
        + "unnest([" + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0e0)" for _, c, _ in _MT) + "]) AS value, "
        + "unnest([" + ", ".join(f"'{u}'" for _, _, u in _MT) + "]) AS unit)"
    ),
)
def q_metrics_table(spark, sf):
    return round_doubles(report.metrics_table(_report(spark, sf)))


@query(
    "rating_palette",
    _rsql(
        """SELECT run_id, topic, ord, category, rating,
  CASE rating WHEN 'Excellent' THEN '#00ff00' WHEN 'Good' THEN '#90EE90' WHEN 'Fair' THEN '#FFD700' WHEN 'Poor' THEN '#FF6B6B' ELSE '#808080' END AS colour
FROM report, LATERAL (SELECT unnest([0, 1]) AS ord, unnest(['Performance', 'Stability']) AS category,
                             unnest([performance_rating, stability_rating]) AS rating)"""
    ),
)
def q_rating_palette(spark, sf):
    return report.rating_colours(_report(spark, sf))


def _band(v: str, good: str, poor: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {good} THEN 'good' WHEN {poor} THEN 'needs improvement' ELSE 'acceptable' END"


SPEC_KPOINTS = 5.0  # a sensor's specified thousand points a second
_PCT = f"(average_kpoints_per_sec / {SPEC_KPOINTS}e0 * 100e0)"


@query(
    "performance_targets",
    _rsql(
        f"""SELECT run_id, topic, ord, metric, round(value, 6) AS value, band FROM report, LATERAL (
  SELECT unnest([0, 1, 2, 3, 4]) AS ord, unnest(['frequency_hz', 'jitter_ms', 'cpu_percent', 'temperature_c', 'throughput_pct_of_spec']) AS metric,
         unnest([average_hz, average_ms, cpu_average_percent, temperature_average_celsius, {_PCT}]) AS value,
         unnest([{_band('average_hz', 'average_hz > 10', 'average_hz < 5')}, {_band('average_ms', 'average_ms < 25', 'average_ms > 50')},
                 {_band('cpu_average_percent', 'cpu_average_percent < 70', 'cpu_average_percent > 80')},
                 {_band('temperature_average_celsius', 'temperature_average_celsius < 70', 'temperature_average_celsius > 80')},
                 {_band(_PCT, _PCT + ' > 80', _PCT + ' < 50')}]) AS band)"""
    ),
)
def q_performance_targets(spark, sf):
    return round_doubles(report.performance_targets(_report(spark, sf), SPEC_KPOINTS))


_ZONE_LONG = """SELECT run_id, 'cpu' AS zone, zone_cpu_millic / 1000e0 AS celsius FROM system_samples WHERE zone_cpu_millic IS NOT NULL UNION ALL SELECT run_id, 'gpu' AS zone, zone_gpu_millic / 1000e0 AS celsius FROM system_samples WHERE zone_gpu_millic IS NOT NULL UNION ALL SELECT run_id, 'aux' AS zone, zone_aux_millic / 1000e0 AS celsius FROM system_samples WHERE zone_aux_millic IS NOT NULL UNION ALL SELECT run_id, 'ao' AS zone, zone_ao_millic / 1000e0 AS celsius FROM system_samples WHERE zone_ao_millic IS NOT NULL UNION ALL SELECT run_id, 'pmic' AS zone, zone_pmic_millic / 1000e0 AS celsius FROM system_samples WHERE zone_pmic_millic IS NOT NULL UNION ALL SELECT run_id, 'tboard' AS zone, zone_tboard_millic / 1000e0 AS celsius FROM system_samples WHERE zone_tboard_millic IS NOT NULL UNION ALL SELECT run_id, 'tdiode' AS zone, zone_tdiode_millic / 1000e0 AS celsius FROM system_samples WHERE zone_tdiode_millic IS NOT NULL"""


@query(
    "system_table",
    _rsql(
        f"""SELECT run_id, topic, ord, resource, round(average, 6) AS average, round("min", 6) AS "min", round("max", 6) AS "max" FROM (
  SELECT run_id, topic, 0 AS ord, 'CPU Usage (%)' AS resource, cpu_average_percent AS average, cpu_min_percent AS "min", cpu_max_percent AS "max" FROM report
  UNION ALL SELECT run_id, topic, 1, 'Memory Usage (%)', memory_average_percent, memory_min_percent, memory_max_percent FROM report
  UNION ALL SELECT run_id, topic, 2, 'CPU Temperature (°C)', temperature_average_celsius, temperature_min_celsius, temperature_max_celsius
            FROM report WHERE temperature_average_celsius IS NOT NULL
  UNION ALL SELECT r.run_id, r.topic, 100, upper(z.zone), z.a, z.mn, z.mx FROM report r JOIN (
            SELECT run_id, zone, avg(celsius) AS a, min(celsius) AS mn, max(celsius) AS mx FROM ({_ZONE_LONG}) GROUP BY run_id, zone) z USING (run_id)
  UNION ALL SELECT run_id, topic, 200, 'Total Samples', CAST(system_samples AS DOUBLE), NULL, NULL FROM report)"""
    ),
)
def q_system_table(spark, sf):
    return round_doubles(report.system_table(_report(spark, sf, with_zones=True)))


@query(
    "run_info_table",
    _rsql(
        """SELECT r.run_id, r.topic, ord, label, value FROM report r JOIN runs USING (run_id, topic), LATERAL (
  SELECT unnest([0, 1, 2, 3, 4]) AS ord,
         unnest(['Test Start Time', 'Test End Time', 'Duration (seconds)', 'Performance Rating', 'Stability Rating']) AS label,
         unnest([strftime(make_timestamp(runs.start_us), '%Y-%m-%dT%H:%M:%S'),
                 strftime(make_timestamp(runs.start_us + CAST(r.duration_seconds * 1e6 AS BIGINT)), '%Y-%m-%dT%H:%M:%S'),
                 CAST(r.duration_seconds AS VARCHAR), coalesce(r.performance_rating, 'N/A'), coalesce(r.stability_rating, 'N/A')]) AS value)"""
    ),
)
def q_run_info_table(spark, sf):
    return report.run_info_table(_report(spark, sf))


# The five tables of a report, and what their columns are in one table of cells: name, text, values.
REPORT_TABLES = {
    "summary": ("summary_table", "metric", None, ["average", "min", "max", "std"]),
    "run_info": ("run_info_table", "label", "value", []),
    "metrics": ("metrics_table", "metric", "unit", ["value"]),
    "system": ("system_table", "resource", None, ["average", "min", "max"]),
    "targets": ("performance_targets", "metric", "band", ["value"]),
}
_VALUES = ["value_1", "value_2", "value_3", "value_4"]


def _cells_sql() -> str:
    """All cells of the five tables, from their own SQL."""
    parts = []
    for name, (q, label, text, values) in REPORT_TABLES.items():
        cols = [*(f'"{v}"' for v in values), *["CAST(NULL AS DOUBLE)"] * 4][:4]
        cells = ", ".join(f"{c} AS {v}" for c, v in zip(cols, _VALUES))
        parts.append(f"""SELECT run_id, topic, '{name}' AS "table", CAST(ord AS INTEGER) AS ord, {label} AS name, {text or 'CAST(NULL AS VARCHAR)'} AS text, {cells} FROM ({ORACLES[q]})""")
    return " UNION ALL ".join(parts)


def written_report_tables(spark, sf) -> tuple[DataFrame, dict]:
    """The report, and the five tables written by the sink, each read back. The report is
    written first, so it is computed once."""
    path = sinks.scratch_path(spark, "tables")
    r = _report(spark, sf, with_zones=True)
    r.write.parquet(f"{path}/report")
    r = spark.read.schema(r.schema).parquet(f"{path}/report")
    made = {"summary": report.summary_table(r), "run_info": report.run_info_table(r), "metrics": report.metrics_table(r),
            "system": report.system_table(r), "targets": report.performance_targets(r, SPEC_KPOINTS)}
    made = {name: round_doubles(t) for name, t in made.items()}
    return r, {name: spark.read.schema(made[name].schema).parquet(f"{path}/{name}") for name in sinks.write_report_tables(made, path, "parquet")}


@query("report_tables_sink", _cells_sql())
def q_report_tables_sink(spark, sf):
    """Every cell of the five written tables."""
    parts = []
    for name, t in written_report_tables(spark, sf)[1].items():
        _, label, text, values = REPORT_TABLES[name]
        cols = [*(F.col(v) for v in values), *[F.lit(None).cast("double")] * 4][:4]
        words = F.col(text) if text else F.lit(None).cast("string")
        parts.append(t.select(*K, F.lit(name).alias("table"), "ord", F.col(label).alias("name"), words.alias("text"), *[c.alias(v) for c, v in zip(cols, _VALUES)]))
    return reduce(DataFrame.unionByName, parts)


@query(
    "run_metadata",
    _rsql(
        f"""SELECT run_id, topic, strftime(make_timestamp(start_us + CAST(duration_seconds * 1e6 AS BIGINT)), '%Y%m%d_%H%M%S') AS timestamp,
  duration_seconds, performance_rating, stability_rating, outputs
FROM report JOIN runs USING (run_id, topic) JOIN (SELECT run_id, topic, count(DISTINCT "table") AS outputs FROM ({_cells_sql()}) GROUP BY ALL) USING (run_id, topic)"""
    ),
)
def q_run_metadata(spark, sf):
    """A15 of the written report, counting the tables that the sink has written."""
    written, made = written_report_tables(spark, sf)
    tables = [t.select(*K, F.lit(name).alias("output")) for name, t in made.items()]
    return report.run_metadata(written, reduce(DataFrame.unionByName, tables))


@query("report_lines")
def q_report_lines(spark, sf):
    return report.report_lines(report.nested_report(round_doubles(_report(spark, sf, with_zones=True))))


_LINE = "'=' || repeat('=', 59)"
_TEXT_PARTS = [
    _LINE, "'LIDAR BENCHMARK SUMMARY'", _LINE,
    "'Frequency Performance:'", f"'  Average: ' || {sql_fixed('average_hz', 2)} || ' Hz'",
    f"'  Range: ' || {sql_fixed('min_hz', 2)} || ' - ' || {sql_fixed('max_hz', 2)} || ' Hz'",
    "'Jitter Analysis:'", f"'  Average: ' || {sql_fixed('average_ms', 2)} || ' ms'",
    f"'  Range: ' || {sql_fixed('min_ms', 2)} || ' - ' || {sql_fixed('max_ms', 2)} || ' ms'",
    "'Bandwidth Usage:'", f"'  Average: ' || {sql_fixed('average_mbps', 2)} || ' Mbps'",
    "'Throughput Performance:'", f"'  Messages/sec: ' || {sql_fixed('average_messages_per_sec', 2)}",
    f"'  MB/sec: ' || {sql_fixed('average_mbytes_per_sec', 2)}", f"'  Points/sec: ' || {sql_fixed('average_kpoints_per_sec', 2)} || 'K'",
    f"'  Points/message: ' || {sql_fixed('average_points_per_message', 0)}",
    "'System Resources:'", f"'  CPU Average: ' || {sql_fixed('cpu_average_percent', 1)} || '%'", f"'  Memory Average: ' || {sql_fixed('memory_average_percent', 1)} || '%'",
    "'Overall Ratings:'", "'  Performance: ' || performance_rating", "'  Stability: ' || stability_rating",
    "'Recommendations:'", "'  - ' || replace(recommendations, '; ', chr(10) || '  - ')", _LINE,
]
_ROUNDED_REPORT = "(SELECT run_id, topic, " + ", ".join(c if c in _INT_COLS else f"round({c}, 6) AS {c}" for c in _REPORT_COLS) + " FROM report)"


@query("text_summary", _rsql(f"SELECT run_id, topic, concat_ws(chr(10), {', '.join(_TEXT_PARTS)}) AS text FROM {_ROUNDED_REPORT}"))
def q_text_summary(spark, sf):
    return report.text_summary(round_doubles(_report(spark, sf)))


_PROCESS_STATS = ", ".join(
    f"{sql_fixed(f'{f}({c})', 2)} AS \"{name}\""
    for name, (f, c) in zip(PROCESS_TABLE_COLUMNS[5:], [(f, c) for c in ("memory_mb", "cpu_percent") for f in ("avg", "min", "max")])
)


@query(
    "top_process_table",
    O.with_ctes(
        O.EV,
        O.PROCESS_SAMPLES,
        _SLOTS_SQL,
        body=f"""SELECT s.run_id, s.host, s.slot, 'Process ' || CAST(s.slot + 1 AS VARCHAR) AS "Process #",
  CASE WHEN trim(any_value(l.name)) = '' THEN 'Process ' || CAST(s.slot + 1 AS VARCHAR) || ' (no name)' ELSE any_value(l.name) END AS "Process Name",
  left(any_value(l.cmdline), 200) AS "Command Line", any_value(l.exe) AS "Executable Path", any_value(l.cwd) AS "Working Dir", {_PROCESS_STATS}
FROM slots s LEFT JOIN labels l USING (run_id, host, slot) GROUP BY s.run_id, s.host, s.slot""",
    ),
)
def q_top_process_table(spark, sf):
    slots, labels = _slot_inputs(spark, sf)
    return report.top_process_table(stats.process_slot_stats(slots, labels, ["run_id", "host", "slot"]))


@query(
    "format_value",
    _rsql(
        f"SELECT run_id, topic, {sql_fixed('average_hz', 2)} AS average_hz, {sql_fixed('cpu_average_percent', 1)} AS cpu, 'N/A' AS missing, "
        f"CAST(samples AS VARCHAR) AS samples FROM {_ROUNDED_REPORT}"
    ),
)
def q_format_value(spark, sf):
    r = round_doubles(_report(spark, sf))
    return r.select(*K, format_value("average_hz", 2).alias("average_hz"), format_value("cpu_average_percent", 1).alias("cpu"),
                    format_value(F.lit(None).cast("double"), 2).alias("missing"), format_value("samples", 0).alias("samples"))


@query(
    "format_kv",
    "WITH t AS (" + ORACLES["tick_metrics"] + ") SELECT run_id, topic, tick, kv.key AS key, kv.value AS value FROM (SELECT run_id, topic, tick, unnest(["
    + ", ".join(f"{{'key': '{c}', 'value': {sql_fixed(f'coalesce(CAST({c} AS DOUBLE), 0e0)', 3, chr(39) + 'nan' + chr(39))}}}" for c in STREAM_KV_METRICS)
    + "]) AS kv FROM t)",
)
def q_format_kv(spark, sf):
    """Every stream metric to text with 3 decimals, as published."""
    t = ticks.tick_metrics(fx.messages(spark, sf), fx.runs(spark, sf))
    return diagnostics.format_kv(t, STREAM_KV_METRICS, 3, [*K, "tick"])
