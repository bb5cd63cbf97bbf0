"""DuckDB SQL oracles: the same projections and operators written as plain SQL window /
aggregate queries over the driver's views (``events`` …). Used by the driver's correctness
check and by ``tests/test_oracle.py``. Each query is an independent formulation (whole-topic
window frames, ASOF-free tick grids), not a transcription of the Spark plan.
"""

from __future__ import annotations

from tickflow.sources.fixtures import BASE_US, COMPRESSION, LOG_PHRASES, ODD_VALUES, RUN_SECONDS

_C = "CASE {col} " + " ".join(f"WHEN '{t}' THEN {c}" for t, c in COMPRESSION.items()) + " END"

# ---------------------------------------------------------------------------------------
# Fixture projections (FIXTURES.md) as CTEs
# ---------------------------------------------------------------------------------------
EV = f"""ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         epoch_us(ts) AS us,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""

MESSAGES = f"""messages AS (
  SELECT 'run-1' AS run_id, event_type AS topic, event_id AS seq,
         {BASE_US} + (us - {BASE_US}) // ({_C.format(col='event_type')}) AS arrival_us,
         CAST(10 * (k + 1) AS INTEGER) AS width, 16 AS height, 16 AS point_step,
         CASE WHEN event_id % 7 = 0 THEN CAST(0 AS BIGINT)
              ELSE CAST(10 * (k + 1) AS BIGINT) * 16 * 16 + 64 END AS data_len
  FROM ev)"""

RUNS = f"""runs AS (
  SELECT DISTINCT 'run-1' AS run_id, event_type AS topic, CAST({BASE_US} AS BIGINT) AS start_us,
         {RUN_SECONDS}e0 / CAST({_C.format(col='event_type')} AS DOUBLE) AS duration_s,
         2e0 AS tick_rate_hz
  FROM events)"""

# W1-W5 per message, whole-topic row frames of 100 rows.
GAUGES = """m AS (
  SELECT run_id, topic, seq, arrival_us,
         CASE WHEN data_len > 0 THEN data_len ELSE CAST(width AS BIGINT) * height * point_step END AS size,
         CAST(width AS BIGINT) * height AS points,
         row_number() OVER (PARTITION BY run_id, topic ORDER BY seq) - 1 AS idx
  FROM messages),
mi AS (
  SELECT *, arrival_us - lag(arrival_us) OVER (PARTITION BY run_id, topic ORDER BY idx) AS interval_us FROM m),
mg AS (
  SELECT *,
    count(interval_us) OVER f AS n_int,
    sum(interval_us) OVER f AS s_int,
    sum(CAST(interval_us AS HUGEINT) * interval_us) OVER f AS s2_int,
    min(interval_us) OVER f AS min_int,
    max(interval_us) OVER f AS max_int,
    count(*) OVER f AS n_ts,
    arrival_us - first_value(arrival_us) OVER f AS span_ts,
    sum(size) OVER f AS size_w,
    sum(points) OVER f AS points_w,
    sum(size) OVER r AS cum_size,
    sum(points) OVER r AS cum_points
  FROM mi
  WINDOW f AS (PARTITION BY run_id, topic ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
         r AS (PARTITION BY run_id, topic ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gauges AS (
  SELECT run_id, topic, seq, idx, arrival_us, size, points, interval_us,
    n_int AS n_intervals,
    CASE WHEN n_int > 0 THEN CASE WHEN s_int = 0 THEN 'inf'::DOUBLE
         ELSE CAST(n_int AS DOUBLE) * 1e6 / CAST(s_int AS DOUBLE) END END AS current_hz,
    CASE WHEN n_int > 0 THEN sqrt(CAST(n_int * s2_int - s_int * s_int AS DOUBLE) / CAST(n_int * n_int AS DOUBLE)) / 1000e0 END AS jitter_ms,
    CAST(min_int AS DOUBLE) / 1000e0 AS min_interval_ms,
    CAST(max_int AS DOUBLE) / 1000e0 AS max_interval_ms,
    n_ts AS n_stamps,
    CASE WHEN span_ts > 0 THEN CAST(n_ts AS DOUBLE) * 1e6 / CAST(span_ts AS DOUBLE) END AS avg_hz,
    CASE WHEN span_ts > 0 THEN CAST(size_w AS DOUBLE) * 8e0 / CAST(span_ts AS DOUBLE) END AS bandwidth_mbps,
    CAST(size_w AS DOUBLE) / CAST(n_ts AS DOUBLE) / 1024e0 AS avg_message_size_kb,
    CAST(points_w AS DOUBLE) / CAST(n_ts AS DOUBLE) AS avg_points_per_message,
    idx + 1 AS total_messages,
    CAST(cum_size AS BIGINT) AS total_bytes,
    CAST(cum_size AS DOUBLE) / 1e6 AS total_mb,
    CAST(cum_points AS BIGINT) AS total_points,
    CAST(cum_points AS DOUBLE) / 1e6 AS total_points_millions
  FROM mg)"""

# J3 + W6 + W7 at ticks.
TICKS = """ctx AS (
  SELECT run_id, topic, start_us, tick_rate_hz, 1e6 / tick_rate_hz AS step_us,
         CAST(floor(duration_s * tick_rate_hz) AS BIGINT) AS nt
  FROM runs),
gt AS (
  SELECT g.run_id, g.topic, g.idx, g.size, g.points,
         greatest(1, CAST(ceil(CAST(g.arrival_us - c.start_us AS DOUBLE) / c.step_us) AS BIGINT)) AS tick, c.nt
  FROM gauges g JOIN ctx c USING (run_id, topic)),
per_tick AS (
  SELECT run_id, topic, tick, count(*) AS d_messages, sum(size) AS d_bytes, sum(points) AS d_points,
         max(idx) AS last_idx
  FROM gt WHERE tick <= nt GROUP BY run_id, topic, tick),
grid AS (
  SELECT run_id, topic, start_us, step_us, unnest(range(1, nt + 1)) AS tick FROM ctx),
tg AS (
  SELECT grid.run_id, grid.topic, grid.start_us, grid.step_us, grid.tick,
         coalesce(p.d_messages, 0) AS d_messages, coalesce(p.d_bytes, 0) AS d_bytes,
         coalesce(p.d_points, 0) AS d_points,
         max(p.last_idx) OVER (PARTITION BY grid.run_id, grid.topic ORDER BY grid.tick
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur_idx
  FROM grid LEFT JOIN per_tick p USING (run_id, topic, tick)),
tf AS (
  SELECT *, min(CASE WHEN cur_idx >= 1 THEN tick END) OVER (PARTITION BY run_id, topic) AS f,
         CAST(ceil(1e6 / step_us) AS BIGINT) AS c
  FROM tg),
tr AS (
  SELECT *,
    CASE WHEN tick <= greatest(f, c) THEN 0 ELSE 1 + (tick - 1 - greatest(f, c)) // c END AS grp,
    CASE WHEN tick <= greatest(f, c) THEN 0 ELSE greatest(f, c) + ((tick - 1 - greatest(f, c)) // c) * c END AS lr
  FROM tf),
ts AS (
  SELECT *,
    sum(d_messages) OVER g AS tm, sum(d_bytes) OVER g AS tb, sum(d_points) OVER g AS tp
  FROM tr
  WINDOW g AS (PARTITION BY run_id, topic, grp ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ticks AS (
  SELECT t.run_id, t.topic, t.tick,
    t.start_us + CAST(round(CAST(t.tick AS DOUBLE) * t.step_us) AS BIGINT) AS tick_us,
    g.current_hz, g.jitter_ms, g.min_interval_ms, g.max_interval_ms, g.avg_hz, g.bandwidth_mbps,
    CAST(g.total_messages AS DOUBLE) / (CAST(t.tick AS DOUBLE) * t.step_us / 1e6) AS overall_avg_hz,
    CAST(g.total_bytes AS DOUBLE) / (CAST(t.tick AS DOUBLE) * t.step_us / 1e6) * 8e0 / 1e6 AS overall_bandwidth_mbps,
    g.total_messages, CAST(g.total_bytes AS DOUBLE) / 1e6 AS total_mb, g.avg_message_size_kb,
    CAST(t.tm AS DOUBLE) / (CAST(t.tick - t.lr AS DOUBLE) * t.step_us / 1e6) AS messages_per_second,
    CAST(t.tb AS DOUBLE) / (CAST(t.tick - t.lr AS DOUBLE) * t.step_us / 1e6) / 1e6 AS mbytes_per_second,
    CAST(t.tp AS DOUBLE) / (CAST(t.tick - t.lr AS DOUBLE) * t.step_us / 1e6) AS points_per_second,
    CAST(t.tp AS DOUBLE) / (CAST(t.tick - t.lr AS DOUBLE) * t.step_us / 1e6) / 1000e0 AS kpoints_per_second,
    g.avg_points_per_message, CAST(g.total_points AS DOUBLE) / 1e6 AS total_points_millions,
    CASE WHEN coalesce(g.current_hz, 0) < 5 THEN 1 WHEN coalesce(g.jitter_ms, 0) > 50 THEN 1 ELSE 0 END AS level,
    CASE WHEN coalesce(g.current_hz, 0) < 5 THEN 'Low frequency detected'
         WHEN coalesce(g.jitter_ms, 0) > 50 THEN 'High jitter detected'
         ELSE 'Operating normally' END AS message,
    g.arrival_us AS last_arrival_us
  FROM ts t JOIN gauges g ON g.run_id = t.run_id AND g.topic = t.topic AND g.idx = t.cur_idx
  WHERE t.tick >= t.f)"""

STREAM_SUMMARY = """kvr AS (
  SELECT run_id, topic,
    round(coalesce(current_hz, 0), 3) AS hz, round(coalesce(jitter_ms, 0), 3) AS jit,
    round(coalesce(bandwidth_mbps, 0), 3) AS bw, round(coalesce(messages_per_second, 0), 3) AS mps,
    round(coalesce(mbytes_per_second, 0), 3) AS mbps, round(coalesce(kpoints_per_second, 0), 3) AS kps,
    round(coalesce(avg_points_per_message, 0), 3) AS ppm
  FROM ticks),
stream_summary AS (
  SELECT run_id, topic, count(*) AS samples,
    avg(hz) AS average_hz, min(hz) AS min_hz, max(hz) AS max_hz, coalesce(stddev_pop(hz), 0) AS std_hz,
    avg(jit) AS average_ms, min(jit) AS min_ms, max(jit) AS max_ms, coalesce(stddev_pop(jit), 0) AS std_ms,
    avg(bw) AS average_mbps, min(bw) AS min_mbps, max(bw) AS max_mbps,
    avg(mps) AS average_messages_per_sec, avg(mbps) AS average_mbytes_per_sec,
    avg(kps) AS average_kpoints_per_sec, max(kps) AS max_kpoints_per_sec,
    coalesce(avg(CASE WHEN ppm > 0 THEN ppm END), 0) AS average_points_per_message
  FROM kvr GROUP BY run_id, topic)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


STREAM_CTES = (EV, MESSAGES, RUNS, GAUGES, TICKS)


_ZONES = ["cpu", "gpu", "aux", "ao", "pmic", "tboard", "tdiode"]
_ZONE_SQL = ",\n         ".join(
    f"CASE WHEN (event_id + {i}) % 3 = 0 OR event_id % 15 = 0 THEN NULL ELSE CAST(40000 + 100 * k + {500 * i} AS BIGINT) END AS zone_{z}_millic"
    for i, z in enumerate(_ZONES)
)

SYSTEM_SAMPLES = f"""system_samples AS (
  SELECT 'run-1' AS run_id, event_type AS host, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS sample_seq,
         {BASE_US} + row_number() OVER (PARTITION BY event_type ORDER BY event_id) * 1000000 AS sample_us,
         least(value, 100e0) AS cpu_percent, CAST(k AS DOUBLE) AS memory_percent,
         CAST(event_id % 5 AS INTEGER) AS cpu_count,
         {_ZONE_SQL},
         [{{'grp': 'coretemp', 'label': 'CPU 0', 'current': 40e0 + k / 10e0}},
          {{'grp': 'coretemp', 'label': 'Core 1', 'current': 41e0}},
          {{'grp': 'cpu_thermal', 'label': '', 'current': 39e0 + k / 10e0}}] AS sensors
  FROM ev)"""

PROCESS_SAMPLES = f"""proc_groups AS (
  SELECT 'h0' AS host, (us - {BASE_US}) // {4 * 3600 * 1000000} AS sample_seq, user_id, sum(cents) AS sc, count(*) AS n
  FROM ev GROUP BY ALL
  UNION ALL
  SELECT 'h1' AS host, (us - {BASE_US}) // {3600 * 1000000} AS sample_seq, user_id, sum(cents) AS sc, count(*) AS n
  FROM ev GROUP BY ALL),
process_samples AS (
  SELECT 'run-1' AS run_id, host, sample_seq, 100 + user_id AS pid, nm AS name,
         CAST((sc // 1000) * 1048576 AS BIGINT) AS rss_bytes, 12.5e0 * n AS cpu_percent,
         repeat(nm || ' --flag ', 40) AS cmdline, '/usr/bin/' || nm AS exe, '/home/' || CAST(user_id AS VARCHAR) AS cwd
  FROM (SELECT *, CASE WHEN (100 + user_id) % 11 = 0 THEN '' ELSE 'p' || CAST((100 + user_id) % 7 AS VARCHAR) END AS nm
        FROM proc_groups))"""

_ODD = "[" + ", ".join(f"'{v}'" for v in ODD_VALUES) + "]"
DIAGNOSTICS = f"""diagnostics AS (
  SELECT 'run-1' AS run_id, event_id AS diag_seq, us AS ts_us,
         CASE event_id % 3 WHEN 0 THEN 'LiDAR Benchmark: /t' WHEN 1 THEN 'System Resources' ELSE 'Other' END AS name,
         0 AS level, 'ok' AS message,
         [{{'key': 'current_hz', 'value': CAST(cents AS VARCHAR)}},
          {{'key': 'jitter_ms', 'value': CAST(k AS VARCHAR)}},
          {{'key': 'top_process_1_name', 'value': 'a'}},
          {{'key': 'top_process_1_name', 'value': 'p' || CAST(user_id AS VARCHAR)}},
          {{'key': 'jetson_gpu_temp_c', 'value': CAST(k AS VARCHAR)}},
          {{'key': 'odd', 'value': ({_ODD})[k % 8 + 1]}}] AS "values"
  FROM ev),
kv AS (
  SELECT run_id, diag_seq, ts_us, name, CAST(p.pos - 1 AS INTEGER) AS pos, p.kv.key AS key, p.kv.value AS value
  FROM diagnostics, LATERAL (SELECT unnest(generate_series(1, len("values"))) AS pos, unnest("values") AS kv) p)"""

_FULL_M = "[value, CAST(k AS DOUBLE), value * 2, 1.5e0, CAST(event_id AS DOUBLE), 0e0, 0e0, 0e0, value * 3]"
METRICS_VECTORS = f"""metrics_vectors AS (
  SELECT 'run-1' AS run_id, event_type AS host, event_id AS seq, event_id * 500000 AS elapsed_us,
         CASE WHEN event_id % 13 = 0 THEN ({_FULL_M})[1:6] ELSE {_FULL_M} END AS data
  FROM ev)"""

_BASE_S = "least(value, 100e0), CAST(k AS DOUBLE), value / 2, CAST(k AS DOUBLE) / 2, CAST(k % 10 AS DOUBLE), value * 3, 40e0 + k / 10e0"
_SLOTS_S = ", ".join(f"value + {i}, CAST(k AS DOUBLE) + {i}" for i in range(20))
_ZONES_S = ", ".join(f"{40 + z}e0 + k / 10e0" for z in range(7))
_FULL_S = f"[{_BASE_S}, {_SLOTS_S}, {_ZONES_S}]"
SYSTEM_VECTORS = f"""system_vectors AS (
  SELECT 'run-1' AS run_id, event_id AS seq, event_id * 500000 AS elapsed_us,
         CASE event_id % 17 WHEN 1 THEN ({_FULL_S})[1:47] WHEN 2 THEN ({_FULL_S})[1:46] WHEN 3 THEN ({_FULL_S})[1:7]
              WHEN 4 THEN ({_FULL_S})[1:6] WHEN 5 THEN CAST([] AS DOUBLE[])
              WHEN 6 THEN list_concat({_FULL_S}, list_transform(range(73), lambda i: value + 0.5e0)) ELSE {_FULL_S} END AS data
  FROM ev)"""

SERIES = f"""series AS (
  SELECT 'run-1' AS run_id, event_type AS series,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx,
         (us - {BASE_US}) // ({_C.format(col='event_type')}) AS elapsed_us,
         CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS value
  FROM ev)"""

SERIES_RUNS = f"""series_runs AS (
  SELECT DISTINCT 'run-1' AS run_id, event_type AS series,
         {RUN_SECONDS}e0 / CAST({_C.format(col='event_type')} AS DOUBLE) AS duration_s
  FROM events)"""

_PHRASES = "[" + ", ".join(f"'{p}'" for p in LOG_PHRASES) + "]"
THERMAL_CSV = """thermal_csv AS (
  SELECT ts, value AS temp_c, 1.5e9 + k * 1e6 AS arm_hz, CAST(CAST(ts AS DATE) AS VARCHAR) AS day
  FROM ev)"""
LOG_LINES = f"""log_lines AS (
  SELECT event_id AS line_no, us AS ts_us, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, k % 8 AS priority,
         ({_PHRASES})[k % 12 + 1] AS line
  FROM ev)"""
