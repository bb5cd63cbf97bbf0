"""Entry point B/C: recorded series, long-run checkpoints and chart-ready shapes; entry point D:
health files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow.functions import rules
from tickflow.functions.scalars import checkpoint_label, time_axis_divisor, time_axis_unit
from tickflow.operators import align, health, stats, windows
from tickflow.plans import oracle as O
from tickflow.plans.registry import query, round_doubles
from tickflow.sources import fixtures as fx

K = ["run_id", "series"]
CHECKPOINT_S = 60.0
DOWNSAMPLE_POINTS = 200
RETAIN = 500


def _sql(body: str, *extra: str) -> str:
    return O.with_ctes(O.EV, O.SERIES, O.SERIES_RUNS, *extra, body=body)


def _series(spark, sf):
    return fx.series(spark, sf)


def _series_runs(spark, sf):
    return fx.runs(spark, sf).select("run_id", F.col("topic").alias("series"), "duration_s")


V = "CASE WHEN isnan(value) THEN NULL ELSE value END"


@query(
    "nan_safe_stats",
    _sql(
        f"""SELECT run_id, series, count(*) AS samples, count({V}) AS valid,
  round(coalesce(avg({V}), 0), 6) AS avg, round(coalesce(min({V}), 0), 6) AS min, round(coalesce(max({V}), 0), 6) AS max,
  round(coalesce(stddev_pop({V}), 0), 6) AS std
FROM series GROUP BY run_id, series"""
    ),
)
def q_nan_safe_stats(spark, sf):
    return round_doubles(stats.nan_safe_stats(_series(spark, sf)))


@query("valid_numbers", _sql("SELECT run_id, series, idx, value FROM series WHERE NOT isnan(value) AND value IS NOT NULL"))
def q_valid_numbers(spark, sf):
    return _series(spark, sf).where(rules.valid_number("value")).select(*K, "idx", "value")


@query(
    "positive_only",
    _sql(f"SELECT run_id, series, round(avg(CASE WHEN {V} > 0 THEN {V} END), 6) AS avg_positive, count(CASE WHEN {V} > 0 THEN 1 END) AS n_positive FROM series GROUP BY run_id, series"),
)
def q_positive_only(spark, sf):
    s = _series(spark, sf).withColumn("_p", rules.positive_only(stats.valid(F.col("value"))))
    return round_doubles(s.groupBy(*K).agg(F.avg("_p").alias("avg_positive"), F.count("_p").alias("n_positive")))


@query(
    "series_stats",
    _sql(
        """SELECT run_id, series, idx // 10 AS part, count(*) AS samples,
  CASE WHEN bool_or(isnan(value)) THEN 'nan'::DOUBLE ELSE round(avg(value), 6) END AS avg,
  CASE WHEN bool_or(isnan(value)) THEN 'nan'::DOUBLE ELSE round(stddev_pop(value), 6) END AS std,
  CASE WHEN bool_or(isnan(value)) THEN 'nan'::DOUBLE ELSE round(min(value), 6) END AS min,
  CASE WHEN bool_or(isnan(value)) THEN 'nan'::DOUBLE ELSE round(max(value), 6) END AS max
FROM series GROUP BY run_id, series, idx // 10"""
    ),
)
def q_series_stats(spark, sf):
    """A8 over stretches of ten samples: some hold a NaN, some don't."""
    return round_doubles(stats.series_stats(_series(spark, sf).withColumn("part", F.expr("idx div 10")), [*K, "part"]))


@query(
    "std_band",
    _sql(
        f"""SELECT run_id, series, round(a, 6) AS avg, round(s, 6) AS std,
  CASE WHEN s > 0 THEN round(a - s, 6) END AS band_low, CASE WHEN s > 0 THEN round(a + s, 6) END AS band_high
FROM (SELECT run_id, series, coalesce(avg({V}), 0) AS a, coalesce(stddev_pop({V}), 0) AS s FROM series GROUP BY run_id, series)"""
    ),
)
def q_std_band(spark, sf):
    s = stats.nan_safe_stats(_series(spark, sf)).select(*K, "avg", "std")
    return round_doubles(stats.std_band(s))


@query(
    "truncate_to_shortest",
    _sql(
        """SELECT a.run_id, b.series AS other, a.idx, a.value AS view_value, b.value AS other_value
FROM (SELECT * FROM series WHERE series = 'view') a JOIN (SELECT * FROM series WHERE series <> 'view') b USING (run_id, idx)"""
    ),
)
def q_truncate_to_shortest(spark, sf):
    s = _series(spark, sf)
    a = s.where(F.col("series") == "view").select("run_id", "idx", F.col("value").alias("view_value"))
    b = s.where(F.col("series") != "view").select("run_id", F.col("series").alias("other"), "idx", F.col("value").alias("other_value"))
    return align.truncate_to_shortest(a, b, ["run_id"])


_CKPT_SQL = f"""grid AS (
  SELECT run_id, series, CAST(duration_s * 1e6 AS BIGINT) AS dur_us, unnest(range(1,
    CASE WHEN CAST(duration_s * 1e6 AS BIGINT) % {int(CHECKPOINT_S * 1e6)} = 0 THEN CAST(duration_s * 1e6 AS BIGINT) // {int(CHECKPOINT_S * 1e6)} + 1
         ELSE CAST(duration_s * 1e6 AS BIGINT) // {int(CHECKPOINT_S * 1e6)} + 2 END)) AS checkpoint
  FROM series_runs),
ckpt AS (
  SELECT g.run_id, g.series, g.checkpoint, least(g.checkpoint * {int(CHECKPOINT_S * 1e6)}, g.dur_us) AS end_us,
         least(g.checkpoint * {int(CHECKPOINT_S * 1e6)}, g.dur_us) = g.dur_us AS is_final,
         count(s.idx) AS samples, count(CASE WHEN isnan(s.value) THEN NULL ELSE s.value END) AS valid,
         coalesce(avg(CASE WHEN isnan(s.value) THEN NULL ELSE s.value END), 0) AS avg,
         coalesce(min(CASE WHEN isnan(s.value) THEN NULL ELSE s.value END), 0) AS min,
         coalesce(max(CASE WHEN isnan(s.value) THEN NULL ELSE s.value END), 0) AS max,
         coalesce(stddev_pop(CASE WHEN isnan(s.value) THEN NULL ELSE s.value END), 0) AS std,
         coalesce(max(s.elapsed_us), 0) AS last_elapsed_us
  FROM grid g LEFT JOIN series s ON s.run_id = g.run_id AND s.series = g.series
       AND s.elapsed_us <= least(g.checkpoint * {int(CHECKPOINT_S * 1e6)}, g.dur_us)
  GROUP BY g.run_id, g.series, g.checkpoint, g.dur_us)"""


@query(
    "cumulative_checkpoints",
    _sql(
        "SELECT run_id, series, checkpoint, end_us, is_final, samples, valid, round(avg, 6) AS avg, round(min, 6) AS min, "
        "round(max, 6) AS max, round(std, 6) AS std, last_elapsed_us FROM ckpt",
        _CKPT_SQL,
    ),
)
def q_cumulative_checkpoints(spark, sf):
    return round_doubles(stats.cumulative_checkpoints(_series(spark, sf), _series_runs(spark, sf), CHECKPOINT_S))


@query(
    "checkpoint_label",
    _sql("SELECT run_id, series, checkpoint, printf('Day%.1f', end_us / 86400e6) AS label FROM ckpt", _CKPT_SQL),
)
def q_checkpoint_label(spark, sf):
    c = stats.cumulative_checkpoints(_series(spark, sf), _series_runs(spark, sf), CHECKPOINT_S)
    return c.select(*K, "checkpoint", checkpoint_label(F.col("end_us") / F.lit(86400e6)).alias("label"))


ROLES = {"hz": "view", "jitter": "click", "bandwidth": "purchase", "throughput": "click", "cpu": "signup", "memory": "error", "temperature": "view"}
_ROLE_STATS = ["avg", "min", "max", "std", "samples"]


_CKPT_REPORT_SQL = _sql(
    """SELECT run_id, checkpoint, printf('Day%.1f', end_us / 86400e6) AS label, last_us / 1e6 AS duration_s, is_final,
  """ + ",\n  ".join(f"{c if s == 'samples' else f'round({c}, 6)'} AS {c}" for r in ROLES for s in _ROLE_STATS for c in [f"{r}_{s}"]) + """,
  CASE WHEN coalesce(hz, 0) >= 20 THEN 'Excellent' WHEN coalesce(hz, 0) >= 10 THEN 'Good' WHEN coalesce(hz, 0) >= 5 THEN 'Fair' ELSE 'Poor' END AS performance_rating,
  CASE WHEN coalesce(jit, 0) <= 10 THEN 'Excellent' WHEN coalesce(jit, 0) <= 25 THEN 'Good' WHEN coalesce(jit, 0) <= 50 THEN 'Fair' ELSE 'Poor' END AS stability_rating,
  coalesce(nullif(array_to_string(list_filter([
     CASE WHEN coalesce(hz, 0) < 10 THEN 'Consider optimizing point cloud processing to improve frequency' END,
     CASE WHEN coalesce(jit, 0) > 50 THEN 'High jitter detected - check for system load or network issues' END,
     CASE WHEN bw > 100 THEN 'High bandwidth usage - consider data compression or reduced resolution' END,
     CASE WHEN cpu > 80 THEN 'High CPU usage - consider performance optimization or hardware upgrade' END,
     CASE WHEN mem > 80 THEN 'High memory usage - check for memory leaks or increase system RAM' END],
     lambda x: x IS NOT NULL), '; '), ''), 'System performing within normal parameters') AS recommendations
FROM (SELECT run_id, checkpoint, end_us, is_final,
        max(CASE WHEN series = 'view' THEN avg END) AS hz, max(CASE WHEN series = 'click' THEN avg END) AS jit,
        max(CASE WHEN series = 'purchase' THEN avg END) AS bw, max(CASE WHEN series = 'signup' THEN avg END) AS cpu,
        max(CASE WHEN series = 'error' THEN avg END) AS mem, max(last_elapsed_us) AS last_us,
        """ + ", ".join(f"coalesce(max(CASE WHEN series = '{v}' THEN {s} END), 0) AS {r}_{s}" for r, v in ROLES.items() for s in _ROLE_STATS) + """
      FROM ckpt GROUP BY run_id, checkpoint, end_us, is_final)""",
    _CKPT_SQL.replace("FROM series_runs)", "FROM (SELECT run_id, series, max(duration_s) OVER (PARTITION BY run_id) AS duration_s FROM series_runs))"),
)


@query("checkpoint_report", _CKPT_REPORT_SQL)
def q_checkpoint_report(spark, sf):
    runs = _series_runs(spark, sf)
    run_len = runs.groupBy("run_id").agg(F.max("duration_s").alias("duration_s"))
    same = runs.select("run_id", "series").join(run_len, "run_id")
    c = stats.cumulative_checkpoints(_series(spark, sf), same, CHECKPOINT_S)
    r = stats.checkpoint_report(c, ROLES)
    return round_doubles(r.select(
        "run_id", "checkpoint", "label", "duration_s", "is_final",
        *[F.coalesce(F.col(f"{r}.{s}"), F.lit(0)).alias(f"{r}_{s}") for r in ROLES for s in _ROLE_STATS],
        "performance_rating", "stability_rating", F.array_join("recommendations", "; ").alias("recommendations"),
    ))


_BIN = f"""CASE WHEN idx < (n // {DOWNSAMPLE_POINTS // 2} + 1) * (n % {DOWNSAMPLE_POINTS // 2})
  THEN idx // (n // {DOWNSAMPLE_POINTS // 2} + 1)
  ELSE n % {DOWNSAMPLE_POINTS // 2} + (idx - (n // {DOWNSAMPLE_POINTS // 2} + 1) * (n % {DOWNSAMPLE_POINTS // 2})) // (n // {DOWNSAMPLE_POINTS // 2}) END"""


@query(
    "minmax_downsample",
    _sql(
        f"""SELECT run_id, series, idx, elapsed_us, value FROM series s
WHERE (SELECT count(*) FROM series t WHERE t.run_id = s.run_id AND t.series = s.series) <= {DOWNSAMPLE_POINTS}
UNION ALL
SELECT s.run_id, s.series, s.idx, s.elapsed_us, s.value FROM series s JOIN (
  SELECT DISTINCT run_id, series, unnest([lo, hi]) AS idx FROM (
    SELECT run_id, series, b, first(idx ORDER BY isnan(value), value, idx) AS lo, first(idx ORDER BY isnan(value), value DESC, idx) AS hi
    FROM (SELECT *, {_BIN} AS b FROM (SELECT *, count(*) OVER (PARTITION BY run_id, series) AS n FROM series) WHERE n > {DOWNSAMPLE_POINTS})
    GROUP BY run_id, series, b)) k USING (run_id, series, idx)"""
    ),
)
def q_minmax_downsample(spark, sf):
    return windows.minmax_downsample(_series(spark, sf), DOWNSAMPLE_POINTS)


@query(
    "keep_last_n",
    _sql(f"SELECT run_id, series, idx, elapsed_us, value FROM series QUALIFY idx > max(idx) OVER (PARTITION BY run_id, series) - {RETAIN}"),
)
def q_keep_last_n(spark, sf):
    return windows.keep_last_n(_series(spark, sf), RETAIN)


# The live view runs over the series in integer cents: window sums of integers are exact in
# any order, so both engines produce the same mean bits without rounding (2-decimal doubles
# summed in engine-specific orders land on either side of 7th-decimal ties).
@query(
    "live_window",
    _sql(
        """SELECT run_id, series, idx, elapsed_us, value, mean_value FROM (
  SELECT run_id, series, idx, elapsed_us, v AS value,
         CAST(sum(v) OVER w AS DOUBLE) / CAST(count(v) OVER w AS DOUBLE) AS mean_value,
         max(elapsed_us) OVER (PARTITION BY run_id, series) AS last_us
  FROM (SELECT *, CASE WHEN isnan(value) THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS v FROM series)
  WINDOW w AS (PARTITION BY run_id, series ORDER BY idx ROWS BETWEEN 599 PRECEDING AND CURRENT ROW))
WHERE elapsed_us >= greatest(0, last_us - 60000000)"""
    ),
)
def q_live_window(spark, sf):
    s = _series(spark, sf)
    cents = F.when(F.isnan("value"), F.lit(None)).otherwise(F.round(F.col("value") * 100).cast("long"))
    return windows.live_window(s.withColumn("value", cents), 60)


@query(
    "histogram",
    _sql(
        """SELECT run_id, series, bin, count(v) AS count, lo, hi
FROM (SELECT *, unnest(range(1, 11)) AS bin FROM bounds) LEFT JOIN placed USING (run_id, series, bin, lo, hi) GROUP BY ALL""",
        f"bounds AS (SELECT run_id, series, min({V}) AS lo, max({V}) AS hi FROM series GROUP BY ALL HAVING count({V}) > 0)",
        f"""placed AS (SELECT run_id, series, lo, hi, {V} AS v,
    CASE WHEN hi = lo THEN 1 ELSE least(10, CAST(floor((({V}) - lo) * 10e0 / (hi - lo)) AS BIGINT) + 1) END AS bin
  FROM series JOIN bounds USING (run_id, series) WHERE ({V}) IS NOT NULL)""",
    ),
)
def q_histogram(spark, sf):
    return stats.histogram(_series(spark, sf), 10)


@query(
    "scale_time_axis",
    _sql(
        """SELECT run_id, series, idx, (elapsed_us / 1e6) / CASE WHEN mx >= 86400 THEN 86400e0 WHEN mx >= 3600 THEN 3600e0 ELSE 1e0 END AS t,
  CASE WHEN mx >= 86400 THEN 'days' WHEN mx >= 3600 THEN 'hours' ELSE 'seconds' END AS unit
FROM (SELECT *, max(elapsed_us) OVER (PARTITION BY run_id, series) / 1e6 AS mx FROM series)"""
    ),
)
def q_scale_time_axis(spark, sf):
    s = _series(spark, sf)
    mx = s.groupBy(*K).agg((F.max("elapsed_us") / F.lit(1e6)).alias("_mx"))
    j = s.join(mx, K)
    return j.select(*K, "idx", ((F.col("elapsed_us") / F.lit(1e6)) / time_axis_divisor("_mx")).alias("t"), time_axis_unit("_mx").alias("unit"))


# process slots by rank (A7) and labels (J4), from the padded top-N of F4
_SLOTS_SQL = """top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id, host, sample_seq ORDER BY rss_bytes DESC, pid ASC) AS INTEGER) AS rank
  FROM process_samples QUALIFY rank <= 20),
labels AS (
  SELECT run_id, host, rank - 1 AS slot, arg_max(name, sample_seq) AS name, arg_max(cmdline, sample_seq) AS cmdline,
         arg_max(exe, sample_seq) AS exe, arg_max(cwd, sample_seq) AS cwd FROM top GROUP BY ALL),
slots AS (
  SELECT t.run_id, t.host, t.sample_seq, t.rank - 1 AS slot, CAST(t.rss_bytes AS DOUBLE) / 1048576e0 AS memory_mb, t.cpu_percent
  FROM top t)"""


def _slot_inputs(spark, sf):
    top = windows.top_n_per_sample(fx.process_samples(spark, sf), 20)
    slots = top.select("run_id", "host", "sample_seq", (F.col("rank") - 1).alias("slot"),
                       (F.col("rss_bytes").cast("double") / F.lit(1048576.0)).alias("memory_mb"), "cpu_percent")
    labels = top.groupBy("run_id", "host", (F.col("rank") - 1).alias("slot")).agg(
        *[F.max_by(c, "sample_seq").alias(c) for c in ("name", "cmdline", "exe", "cwd")]
    )
    return slots, labels


@query(
    "process_slot_stats",
    O.with_ctes(
        O.EV,
        O.PROCESS_SAMPLES,
        _SLOTS_SQL,
        body="""SELECT s.run_id, s.host, s.slot, count(memory_mb) AS memory_samples, round(avg(memory_mb), 6) AS memory_avg_mb,
  round(min(memory_mb), 6) AS memory_min_mb, round(max(memory_mb), 6) AS memory_max_mb, count(cpu_percent) AS cpu_samples,
  round(avg(cpu_percent), 6) AS cpu_avg_percent, round(min(cpu_percent), 6) AS cpu_min_percent, round(max(cpu_percent), 6) AS cpu_max_percent,
  any_value(l.name) AS name, any_value(l.cmdline) AS cmdline, any_value(l.exe) AS exe, any_value(l.cwd) AS cwd
FROM slots s LEFT JOIN labels l USING (run_id, host, slot) GROUP BY s.run_id, s.host, s.slot""",
    ),
)
def q_process_slot_stats(spark, sf):
    slots, labels = _slot_inputs(spark, sf)
    return round_doubles(stats.process_slot_stats(slots, labels, ["run_id", "host", "slot"]))


@query(
    "attach_slot_labels",
    O.with_ctes(O.EV, O.PROCESS_SAMPLES, _SLOTS_SQL, body="SELECT s.run_id, s.host, s.sample_seq, s.slot, s.memory_mb, l.name FROM slots s JOIN labels l USING (run_id, host, slot) WHERE l.name <> ''"),
)
def q_attach_slot_labels(spark, sf):
    slots, labels = _slot_inputs(spark, sf)
    j = align.attach_slot_labels(slots.select("run_id", "host", "sample_seq", "slot", "memory_mb"), labels, ["run_id", "host", "slot"], "inner")
    return j.where(F.col("name") != "").select("run_id", "host", "sample_seq", "slot", "memory_mb", "name")


# ---------------------------------------------------------------------------------------
# Health (F9)
# ---------------------------------------------------------------------------------------
def _health_sql(body: str) -> str:
    return O.with_ctes(O.EV, O.THERMAL_CSV, O.LOG_LINES, body=body)


def _logs(spark, sf):
    return fx.log_lines(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "thermal_clock_summary",
    _health_sql(
        """SELECT day, count(*) AS rows, round(avg(temp_c), 6) AS avg_temp_c, round(greatest(max(temp_c), 0e0), 6) AS max_temp_c,
  round(avg(arm_hz), 6) AS avg_arm_hz, round(greatest(max(arm_hz), 0e0), 6) AS max_arm_hz FROM thermal_csv GROUP BY day"""
    ),
)
def q_thermal_clock_summary(spark, sf):
    t = fx.thermal_csv(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return round_doubles(health.thermal_clock_summary(t))


@query(
    "thermal_day_status",
    _health_sql(
        """SELECT d.day, CASE WHEN t.n IS NULL THEN 'no data' ELSE 'ok' END AS status, coalesce(t.n, 0) AS rows,
  round(t.a, 6) AS avg_temp_c, round(t.m, 6) AS max_temp_c
FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) d
LEFT JOIN (SELECT day, count(*) AS n, avg(temp_c) AS a, greatest(max(temp_c), 0e0) AS m FROM thermal_csv GROUP BY day) t USING (day)"""
    ),
)
def q_thermal_day_status(spark, sf):
    days = fx.events(spark, sf).select(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"))
    t = fx.thermal_csv(spark, sf).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return round_doubles(health.thermal_day_status(days, t))


_PATTERNS = "['oom', 'out of memory', 'watchdog', 'segfault', 'backtrace', 'panic', 'GPU hang', 'I/O error', 'fatal', 'emergency']"


@query(
    "log_pattern_report",
    _health_sql(
        f"""SELECT day, pattern, count(*) AS lines FROM (
  SELECT day, unnest(list_filter({_PATTERNS}, lambda p: contains(lower(line), lower(p)))) AS pattern FROM log_lines)
GROUP BY day, pattern"""
    ),
)
def q_log_pattern_report(spark, sf):
    return health.log_pattern_report(_logs(spark, sf))


SINCE_US = fx.BASE_US + 28 * 86400 * 1000000


@query(
    "log_severity",
    _health_sql(f"SELECT line_no, ts_us, priority, line FROM log_lines WHERE priority BETWEEN 0 AND 3 AND ts_us >= {SINCE_US}"),
)
def q_log_severity(spark, sf):
    return health.log_severity(_logs(spark, sf), SINCE_US).select("line_no", "ts_us", "priority", "line")


@query(
    "boot_events",
    _health_sql("SELECT line_no, ts_us, line FROM log_lines WHERE regexp_matches(lower(line), 'reboot|shutdown') ORDER BY ts_us DESC, line_no DESC LIMIT 20"),
)
def q_boot_events(spark, sf):
    return health.boot_events(_logs(spark, sf), 20).select("line_no", "ts_us", "line")


_VERDICT = " OR ".join(f"contains(lower(line), '{p}')" for p in ["oom", "out of memory", "watchdog", "segfault", "panic", "fatal", "emergency"])


@query(
    "health_verdict",
    _health_sql(f"SELECT day, bool_or({_VERDICT}) AS unhealthy, CAST(sum(CASE WHEN {_VERDICT} THEN 1 ELSE 0 END) AS BIGINT) AS bad_lines FROM log_lines GROUP BY day"),
)
def q_health_verdict(spark, sf):
    return health.health_verdict(_logs(spark, sf))
