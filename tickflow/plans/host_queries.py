"""Host samples, processes, diagnostics and wire vectors (entry point A system side, §2.3-2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickflow.functions import rules
from tickflow.functions.scalars import (
    normalise_cpu,
    process_display_name,
    sensor_mean_temperature,
    slot_from_key,
    truncate_text,
    zone_from_key,
    zone_mean_temperature,
)
from tickflow.functions.vectors import decode_metrics_vector, decode_system_vector, encode_system_vector
from tickflow.operators import align, diagnostics, processes, ticks, windows
from tickflow.plans import oracle as O
from tickflow.plans.registry import query, round_doubles
from tickflow.plans.stream_queries import _ticks as tick_rows
from tickflow.schemas import SYSTEM_BASE
from tickflow.sources import fixtures as fx

H = ["run_id", "host"]
S = ["run_id", "host", "sample_seq"]


def _sys_sql(body: str) -> str:
    return O.with_ctes(O.EV, O.SYSTEM_SAMPLES, body=body)


def _proc_sql(body: str, *extra: str) -> str:
    return O.with_ctes(O.EV, O.PROCESS_SAMPLES, *extra, body=body)


def _cpu_temp():
    return F.coalesce(zone_mean_temperature(fx.ZONE_COLS), sensor_mean_temperature("sensors"))


_ZONE_MEAN_SQL = (
    "(SELECT avg(x / 1000e0) FROM unnest([" + ", ".join(fx.ZONE_COLS) + "]) t(x) WHERE x IS NOT NULL)"
)
_SENSOR_MEAN_SQL = (
    "(SELECT avg(s.current) FROM unnest(sensors) t(s) WHERE contains(lower(s.grp), 'cpu') OR contains(lower(s.label), 'cpu'))"
)


# ---------------------------------------------------------------------------------------
# System samples
# ---------------------------------------------------------------------------------------
@query(
    "rolling_mean_samples",
    _sys_sql(
        """SELECT run_id, host, sample_seq,
  round(avg(coalesce(cpu_percent, 0)) OVER w, 8) AS cpu_percent_avg,
  round(avg(coalesce(memory_percent, 0)) OVER w, 8) AS memory_percent_avg
FROM system_samples WINDOW w AS (PARTITION BY run_id, host ORDER BY sample_seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
    ),
)
def q_rolling_mean_samples(spark, sf):
    return round_doubles(windows.rolling_mean_samples(fx.system_samples(spark, sf), n=60), 8)  # at 6 digits means of cents tie


@query(
    "system_level",
    _sys_sql(
        """SELECT run_id, host, sample_seq,
  CASE WHEN cpu_percent > 90 THEN 2 WHEN cpu_percent > 70 THEN 1 WHEN memory_percent > 90 THEN 2 WHEN memory_percent > 70 THEN 1 ELSE 0 END AS level,
  CASE WHEN cpu_percent > 90 THEN 'CPU usage critical' WHEN cpu_percent > 70 THEN 'High CPU usage'
       WHEN memory_percent > 90 THEN 'Memory usage critical' WHEN memory_percent > 70 THEN 'High memory usage'
       ELSE 'System resources normal' END AS message
FROM system_samples"""
    ),
)
def q_system_level(spark, sf):
    s = fx.system_samples(spark, sf)
    lv = rules.system_level("cpu_percent", "memory_percent")
    return s.select(*S, lv["level"].alias("level"), lv["message"].alias("message"))


@query(
    "system_summary",
    _sys_sql(
        """SELECT run_id, host, count(*) AS samples,
  round(avg(coalesce(cpu_percent, 0)), 6) AS cpu_average_percent, round(max(coalesce(cpu_percent, 0)), 6) AS cpu_max_percent,
  round(min(coalesce(cpu_percent, 0)), 6) AS cpu_min_percent,
  round(avg(coalesce(memory_percent, 0)), 6) AS memory_average_percent, round(max(coalesce(memory_percent, 0)), 6) AS memory_max_percent,
  round(min(coalesce(memory_percent, 0)), 6) AS memory_min_percent
FROM system_samples GROUP BY run_id, host"""
    ),
)
def q_system_summary(spark, sf):
    return round_doubles(processes.system_summary(fx.system_samples(spark, sf)))


@query(
    "zone_mean_temperature",
    _sys_sql(f"SELECT run_id, host, sample_seq, round({_ZONE_MEAN_SQL}, 6) AS zone_mean_c FROM system_samples"),
)
def q_zone_mean_temperature(spark, sf):
    s = fx.system_samples(spark, sf)
    return round_doubles(s.select(*S, zone_mean_temperature(fx.ZONE_COLS).alias("zone_mean_c")))


@query(
    "sensor_mean_temperature",
    _sys_sql(f"SELECT run_id, host, sample_seq, round({_SENSOR_MEAN_SQL}, 6) AS sensor_mean_c FROM system_samples"),
)
def q_sensor_mean_temperature(spark, sf):
    s = fx.system_samples(spark, sf)
    return round_doubles(s.select(*S, sensor_mean_temperature("sensors").alias("sensor_mean_c")))


@query(
    "temperature_summary",
    _sys_sql(
        f"""SELECT run_id, host, count(*) AS samples, round(avg(t), 6) AS temperature_average_celsius, round(max(t), 6) AS temperature_max_celsius,
  round(min(t), 6) AS temperature_min_celsius
FROM (SELECT run_id, host, coalesce({_ZONE_MEAN_SQL}, {_SENSOR_MEAN_SQL}) AS t FROM system_samples) WHERE t > 0
GROUP BY run_id, host"""
    ),
)
def q_temperature_summary(spark, sf):
    s = fx.system_samples(spark, sf).withColumn("cpu_temp_c", _cpu_temp())
    return round_doubles(processes.temperature_summary(s))


_ZONE_LONG_SQL = " UNION ALL ".join(
    f"SELECT run_id, host, '{z}' AS zone, zone_{z}_millic / 1000e0 AS celsius FROM system_samples WHERE zone_{z}_millic IS NOT NULL"
    for z in ["cpu", "gpu", "aux", "ao", "pmic", "tboard", "tdiode"]
)


@query(
    "zone_summary",
    _sys_sql(
        f"""SELECT run_id, host, zone, count(*) AS samples, round(avg(celsius), 6) AS average_celsius, round(max(celsius), 6) AS max_celsius,
  round(min(celsius), 6) AS min_celsius FROM ({_ZONE_LONG_SQL}) GROUP BY run_id, host, zone"""
    ),
)
def q_zone_summary(spark, sf):
    s = fx.system_samples(spark, sf)
    zones = F.array(
        *[F.struct(F.lit(c.split("_")[1]).alias("zone"), (F.col(c) / F.lit(1000.0)).alias("celsius")) for c in fx.ZONE_COLS]
    )
    long = s.select(*H, F.explode(zones).alias("z")).select(*H, "z.zone", "z.celsius").where(F.col("celsius").isNotNull())
    return round_doubles(processes.zone_summary(long))


@query(
    "normalise_cpu",
    _sys_sql(
        "SELECT run_id, host, sample_seq, CASE WHEN cpu_count > 0 THEN cpu_percent / cpu_count ELSE cpu_percent END AS cpu_norm FROM system_samples"
    ),
)
def q_normalise_cpu(spark, sf):
    s = fx.system_samples(spark, sf)
    return s.select(*S, normalise_cpu("cpu_percent", "cpu_count").alias("cpu_norm"))


@query(
    "align_asof",
    O.with_ctes(
        O.EV,
        O.MESSAGES,
        O.SYSTEM_SAMPLES,
        body="""SELECT m.run_id, m.topic, m.seq, m.arrival_us, s.sample_us AS r_time, s.sample_seq AS r_sample_seq,
  s.cpu_percent AS r_cpu_percent, s.memory_percent AS r_memory_percent
FROM messages m ASOF LEFT JOIN system_samples s ON m.run_id = s.run_id AND m.topic = s.host AND m.arrival_us >= s.sample_us""",
    ),
)
def q_align_asof(spark, sf):
    m = fx.messages(spark, sf).select("run_id", "topic", "seq", "arrival_us")
    s = fx.system_samples(spark, sf).withColumnRenamed("host", "topic")  # each topic's own host
    return align.align_asof(m, s, ["run_id", "topic"], "arrival_us", "sample_us", ["sample_seq", "cpu_percent", "memory_percent"])


@query(
    "sample_staleness",
    O.with_ctes(
        *O.STREAM_CTES,
        O.SYSTEM_SAMPLES,
        body="""SELECT t.run_id, t.topic, t.tick, CAST(t.tick_us - s.sample_us AS DOUBLE) / 1e6 AS stale_s
FROM ticks t ASOF LEFT JOIN system_samples s ON t.run_id = s.run_id AND t.topic = s.host AND t.tick_us >= s.sample_us""",
    ),
)
def q_sample_staleness(spark, sf):
    """F15 for the host samples: each topic's own host."""
    s = fx.system_samples(spark, sf).withColumnRenamed("host", "topic")
    return ticks.sample_staleness(tick_rows(spark, sf), s)


@query(
    "positional_zip",
    O.with_ctes(
        O.EV,
        O.METRICS_VECTORS,
        O.SYSTEM_SAMPLES,
        body=f"""SELECT run_id, host, k, metrics_time, sys_seq, sys_time FROM (
  SELECT z.run_id, z.host, z.a_n AS k, z.sys_seq, z.sys_time, z.a_n > coalesce(lag(z.a_n) OVER (PARTITION BY z.run_id, z.host ORDER BY z.n), 0) AS accepted
  FROM (SELECT *, n + least(0, min(t_n - n) OVER (PARTITION BY run_id, host ORDER BY n ROWS UNBOUNDED PRECEDING)) AS a_n
        FROM (SELECT s.run_id, s.host, s.sample_seq AS sys_seq, s.sample_us - {fx.BASE_US} AS sys_time,
                     row_number() OVER (PARTITION BY s.run_id, s.host ORDER BY s.sample_seq) AS n,
                     (SELECT count(*) FROM metrics_vectors mv WHERE mv.run_id = s.run_id AND mv.host = s.host AND mv.elapsed_us <= s.sample_us - {fx.BASE_US}) AS t_n
              FROM system_samples s)) z) a
JOIN (SELECT run_id, host, row_number() OVER (PARTITION BY run_id, host ORDER BY seq) AS k, elapsed_us AS metrics_time FROM metrics_vectors) m
USING (run_id, host, k) WHERE accepted""",
    ),
)
def q_positional_zip(spark, sf):
    mv = fx.metrics_vectors(spark, sf).select("run_id", "host", "seq", "elapsed_us")
    ss = fx.system_samples(spark, sf).select("run_id", "host", F.col("sample_seq").alias("seq"), (F.col("sample_us") - F.lit(fx.BASE_US)).alias("elapsed_us"))
    return align.positional_zip(mv, ss, ["run_id", "host"], "elapsed_us", "seq")


# ---------------------------------------------------------------------------------------
# Processes
# ---------------------------------------------------------------------------------------
_TOP_SQL = """top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id, host, sample_seq ORDER BY rss_bytes DESC, pid ASC) AS INTEGER) AS rank
  FROM process_samples QUALIFY rank <= 20)"""


@query("top_n_per_sample", _proc_sql("SELECT run_id, host, sample_seq, rank, pid, rss_bytes FROM top", _TOP_SQL))
def q_top_n_per_sample(spark, sf):
    return windows.top_n_per_sample(fx.process_samples(spark, sf), 20).select(*S, "rank", "pid", "rss_bytes")


@query(
    "first_seen_zero",
    _proc_sql(
        """SELECT run_id, host, sample_seq, pid, cpu_percent,
  CASE WHEN lag(sample_seq) OVER (PARTITION BY run_id, host, pid ORDER BY sample_seq) = sample_seq - 1 THEN cpu_percent ELSE 0e0 END AS cpu_percent_reported
FROM top""",
        _TOP_SQL,
    ),
)
def q_first_seen_zero(spark, sf):
    top = windows.top_n_per_sample(fx.process_samples(spark, sf), 20)
    return windows.first_seen_zero(top).select(*S, "pid", "cpu_percent", "cpu_percent_reported")


_PAD_SQL = """padded AS (
  SELECT g.run_id, g.host, g.sample_seq, g.rank, coalesce(t.pid, 0) AS pid, coalesce(t.name, '') AS name,
    coalesce(CASE WHEN t.pid IS NULL THEN NULL WHEN t.name <> '' THEN t.name || ' (PID:' || CAST(t.pid AS VARCHAR) || ')'
                  WHEN t.pid > 0 THEN 'PID:' || CAST(t.pid AS VARCHAR) ELSE '' END, '') AS display_name,
    coalesce(CAST(t.rss_bytes AS DOUBLE) / 1048576e0, 0e0) AS memory_mb, coalesce(t.cpu_percent, 0e0) AS cpu_percent,
    coalesce(substr(t.cmdline, 1, 200), '') AS cmdline, coalesce(t.exe, '') AS exe, coalesce(t.cwd, '') AS cwd
  FROM (SELECT DISTINCT run_id, host, sample_seq, CAST(unnest(range(1, 21)) AS INTEGER) AS rank FROM top) g
  LEFT JOIN top t USING (run_id, host, sample_seq, rank))"""


def _padded(spark, sf):
    return processes.pad_slots(processes.top_processes(fx.process_samples(spark, sf)))


@query("pad_slots", _proc_sql("SELECT * FROM padded", _TOP_SQL, _PAD_SQL))
def q_pad_slots(spark, sf):
    return _padded(spark, sf)


_PIVOT_COLS = ", ".join(
    f"max(CASE WHEN rank = {i} THEN memory_mb END) AS top_process_{i}_memory_mb, "
    f"max(CASE WHEN rank = {i} THEN cpu_percent END) AS top_process_{i}_cpu_percent, "
    f"max(CASE WHEN rank = {i} THEN display_name END) AS top_process_{i}_display_name"
    for i in range(1, 21)
)


@query("pivot_slots", _proc_sql(f"SELECT run_id, host, sample_seq, {_PIVOT_COLS} FROM padded GROUP BY run_id, host, sample_seq", _TOP_SQL, _PAD_SQL))
def q_pivot_slots(spark, sf):
    return processes.pivot_slots(_padded(spark, sf))


@query(
    "unpivot_slots",
    _proc_sql("SELECT run_id, host, sample_seq, rank, memory_mb, cpu_percent, display_name FROM padded", _TOP_SQL, _PAD_SQL),
)
def q_unpivot_slots(spark, sf):
    return processes.unpivot_slots(processes.pivot_slots(_padded(spark, sf)))


@query(
    "process_display_name",
    _proc_sql(
        """SELECT run_id, host, sample_seq, pid,
  CASE WHEN name <> '' THEN name || ' (PID:' || CAST(pid AS VARCHAR) || ')' WHEN pid > 0 THEN 'PID:' || CAST(pid AS VARCHAR) ELSE '' END AS display_name
FROM process_samples"""
    ),
)
def q_process_display_name(spark, sf):
    p = fx.process_samples(spark, sf)
    return p.select(*S, "pid", process_display_name("name", "pid").alias("display_name"))


@query("truncate_text", _proc_sql("SELECT run_id, host, sample_seq, pid, substr(cmdline, 1, 200) AS cmdline FROM process_samples"))
def q_truncate_text(spark, sf):
    p = fx.process_samples(spark, sf)
    return p.select(*S, "pid", truncate_text("cmdline").alias("cmdline"))


@query(
    "watched_process",
    _proc_sql(
        """SELECT s.run_id, s.host, s.sample_seq, c.watched_pid,
  coalesce(p.cpu_percent, 0e0) AS process_cpu_percent, coalesce(CAST(p.rss_bytes AS DOUBLE) / 1048576e0, 0e0) AS process_memory_mb,
  CAST(coalesce(p.pid % 9 + 1, 0) AS INTEGER) AS process_threads
FROM (SELECT DISTINCT run_id, host, sample_seq FROM process_samples) s
JOIN (SELECT run_id, host, min(pid) AS watched_pid FROM process_samples WHERE contains(name, 'p3') GROUP BY run_id, host) c USING (run_id, host)
LEFT JOIN process_samples p ON p.run_id = s.run_id AND p.host = s.host AND p.sample_seq = s.sample_seq AND p.pid = c.watched_pid"""
    ),
)
def q_watched_process(spark, sf):
    procs = fx.process_samples(spark, sf).withColumn("threads", F.col("pid") % 9 + 1)
    return align.watched_process(procs, "p3")


@query(
    "process_stats",
    _proc_sql(
        """SELECT run_id, host, pid, name, count(*) AS samples,
  round(avg(rss_bytes / 1048576e0), 6) AS avg_memory_mb, round(max(rss_bytes / 1048576e0), 6) AS max_memory_mb,
  round(min(rss_bytes / 1048576e0), 6) AS min_memory_mb, round(avg(cpu_percent), 6) AS avg_cpu_percent,
  round(max(cpu_percent), 6) AS max_cpu_percent, round(min(cpu_percent), 6) AS min_cpu_percent
FROM process_samples GROUP BY run_id, host, pid, name"""
    ),
)
def q_process_stats(spark, sf):
    return round_doubles(processes.process_stats(fx.process_samples(spark, sf)))


# ---------------------------------------------------------------------------------------
# Diagnostics
# ---------------------------------------------------------------------------------------
def _diag_sql(body: str) -> str:
    return O.with_ctes(O.EV, O.DIAGNOSTICS, body=body)


_NUM_RE = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


@query(
    "route_status",
    _diag_sql(
        """SELECT run_id, diag_seq, CASE WHEN contains(name, 'LiDAR Benchmark') THEN 'stream' WHEN contains(name, 'System Resources') THEN 'system' END AS route
FROM diagnostics WHERE contains(name, 'LiDAR Benchmark') OR contains(name, 'System Resources')"""
    ),
)
def q_route_status(spark, sf):
    return diagnostics.routed(fx.diagnostics(spark, sf)).select("run_id", "diag_seq", "route")


@query(
    "parse_kv",
    _diag_sql(
        f"""SELECT run_id, diag_seq, key,
  CASE WHEN regexp_full_match(value, '{_NUM_RE}') THEN TRY_CAST(trim(value) AS DOUBLE) END AS num,
  CASE WHEN NOT regexp_full_match(value, '{_NUM_RE}') OR TRY_CAST(trim(value) AS DOUBLE) IS NULL THEN value END AS text
FROM (SELECT run_id, diag_seq, key, arg_max(value, pos) AS value FROM kv GROUP BY run_id, diag_seq, key)"""
    ),
)
def q_parse_kv(spark, sf):
    return diagnostics.parse_kv(fx.diagnostics(spark, sf))


@query(
    "latest_by_key",
    _diag_sql(
        """SELECT run_id, CAST(regexp_extract(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$', 1) AS INTEGER) - 1 AS slot,
  regexp_extract(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$', 2) AS field,
  arg_max(value, (ts_us, diag_seq, pos)) AS value
FROM kv WHERE name = 'System Resources' AND regexp_full_match(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$')
  AND CAST(regexp_extract(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$', 1) AS INTEGER) BETWEEN 1 AND 20
GROUP BY ALL"""
    ),
)
def q_latest_by_key(spark, sf):
    return diagnostics.latest_by_key(fx.diagnostics(spark, sf))


@query(
    "zone_from_key",
    _diag_sql(
        """SELECT run_id, diag_seq, pos, key, regexp_extract(key, '^jetson_(.*)_temp_c$', 1) AS zone
FROM kv WHERE regexp_full_match(key, '^jetson_.*_temp_c$')"""
    ),
)
def q_zone_from_key(spark, sf):
    kv = diagnostics.explode_kv(fx.diagnostics(spark, sf))
    z = kv.withColumn("zone", zone_from_key("key")).where(F.col("zone").isNotNull())
    return z.select("run_id", "diag_seq", "pos", "key", "zone")


@query(
    "slot_from_key",
    _diag_sql(
        """SELECT run_id, diag_seq, pos, key,
  CAST(regexp_extract(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$', 1) AS INTEGER) - 1 AS slot,
  regexp_extract(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$', 2) AS field
FROM kv WHERE regexp_full_match(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$')
  AND CAST(regexp_extract(key, '^top_process_([0-9]+)_(name|cmdline|exe|cwd)$', 1) AS INTEGER) BETWEEN 1 AND 20"""
    ),
)
def q_slot_from_key(spark, sf):
    kv = diagnostics.explode_kv(fx.diagnostics(spark, sf))
    s = kv.withColumn("_s", slot_from_key("key")).where(F.col("_s").isNotNull())
    return s.select("run_id", "diag_seq", "pos", "key", F.col("_s.slot").alias("slot"), F.col("_s.field").alias("field"))


# ---------------------------------------------------------------------------------------
# Wire vectors
# ---------------------------------------------------------------------------------------
_MNAMES = ["current_hz", "jitter_ms", "bandwidth_mbps", "avg_message_size_kb", "total_messages", "total_mb",
           "messages_per_second", "mbytes_per_second", "kpoints_per_second"]


@query(
    "decode_metrics_vector",
    O.with_ctes(
        O.EV,
        O.METRICS_VECTORS,
        body="SELECT run_id, seq, elapsed_us, "
        + ", ".join(f"CASE WHEN len(data) >= 9 THEN data[{i + 1}] ELSE 'nan'::DOUBLE END AS {n}" for i, n in enumerate(_MNAMES))
        + " FROM metrics_vectors",
    ),
)
def q_decode_metrics_vector(spark, sf):
    v = fx.metrics_vectors(spark, sf)
    return v.select("run_id", "seq", "elapsed_us", decode_metrics_vector("data", "nan").alias("m")).select(
        "run_id", "seq", "elapsed_us", "m.*"
    )


_SYS_DECODE_SQL = (
    "SELECT run_id, seq, "
    + ", ".join(f"CASE WHEN len(data) >= 7 THEN data[{i + 1}] ELSE 'nan'::DOUBLE END AS {n}" for i, n in enumerate(SYSTEM_BASE))
    + ", CASE WHEN len(data) >= 47 THEN list_transform(range(20), lambda i: data[8 + 2 * i]) ELSE list_transform(range(20), lambda i: 'nan'::DOUBLE) END AS slot_memory_mb"
    + ", CASE WHEN len(data) >= 47 THEN list_transform(range(20), lambda i: data[9 + 2 * i]) ELSE list_transform(range(20), lambda i: 'nan'::DOUBLE) END AS slot_cpu_percent"
    + ", CASE WHEN len(data) > 47 THEN data[48:] ELSE CAST([] AS DOUBLE[]) END AS zones"
    + " FROM system_vectors"
)


@query("decode_system_vector", O.with_ctes(O.EV, O.SYSTEM_VECTORS, body=_SYS_DECODE_SQL))
def q_decode_system_vector(spark, sf):
    v = fx.system_vectors(spark, sf).select("run_id", "seq", decode_system_vector("data").alias("d"))
    return v.select(
        "run_id",
        "seq",
        *[F.col(f"d.{n}").alias(n) for n in SYSTEM_BASE],
        F.transform("d.slots", lambda s: s["memory_mb"]).alias("slot_memory_mb"),
        F.transform("d.slots", lambda s: s["cpu_percent"]).alias("slot_cpu_percent"),
        F.col("d.zones").alias("zones"),
    )


@query("encode_system_vector", O.with_ctes(O.EV, O.SYSTEM_VECTORS, body="SELECT run_id, seq, data FROM system_vectors WHERE len(data) >= 47"))
def q_encode_system_vector(spark, sf):
    v = fx.system_vectors(spark, sf).where(F.size("data") >= 47).select("run_id", "seq", decode_system_vector("data").alias("d"))
    base = [F.col(f"d.{n}") for n in SYSTEM_BASE]
    return v.select("run_id", "seq", encode_system_vector(base, F.col("d.slots"), F.col("d.zones")).alias("data"))


@query(
    "zone_kv_summary",
    _diag_sql(
        f"""SELECT run_id, zone, count(*) AS samples, round(avg(celsius), 6) AS average_celsius, round(max(celsius), 6) AS max_celsius,
  round(min(celsius), 6) AS min_celsius
FROM (SELECT run_id, regexp_extract(key, '^jetson_(.*)_temp_c$', 1) AS zone,
             CASE WHEN regexp_full_match(value, '{_NUM_RE}') THEN TRY_CAST(trim(value) AS DOUBLE) END AS celsius
      FROM (SELECT run_id, diag_seq, key, arg_max(value, pos) AS value FROM kv
            WHERE contains(name, 'System Resources') GROUP BY run_id, diag_seq, key)
      WHERE regexp_full_match(key, '^jetson_.*_temp_c$'))
WHERE celsius IS NOT NULL GROUP BY run_id, zone"""
    ),
)
def q_zone_kv_summary(spark, sf):
    """A4 from the diagnostics: per discovered ``jetson_<zone>_temp_c`` key, stats over all values."""
    z = diagnostics.zone_values(fx.diagnostics(spark, sf))
    return round_doubles(
        z.groupBy("run_id", "zone").agg(
            F.count(F.lit(1)).alias("samples"),
            F.avg("celsius").alias("average_celsius"),
            F.max("celsius").alias("max_celsius"),
            F.min("celsius").alias("min_celsius"),
        )
    )
