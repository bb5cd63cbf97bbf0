"""Entry point A: message stream → per-message gauges → ticks → run summary and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.functions import rules
from tickflow.functions.scalars import convert_units, elapsed_seconds, message_size, point_count
from tickflow.operators import stats, ticks, windows
from tickflow.plans import oracle as O
from tickflow.plans.registry import query, round_doubles
from tickflow.session import per_session
from tickflow.sources import fixtures as fx

K = ["run_id", "topic"]


@per_session
def summary_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick metrics for the run summaries, which do not read the interval min/max."""
    return ticks.tick_metrics(fx.messages(spark, sf_dir), fx.runs(spark, sf_dir), with_min_max=False)


def stream_summary_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = summary_ticks(spark, sf_dir)
    s = stats.with_ratings(stats.stream_summary(t))
    return round_doubles(s, text_arrays={"recommendations": "; "})


STREAM_SUMMARY_SQL = O.with_ctes(
    *O.STREAM_CTES,
    O.STREAM_SUMMARY,
    body="""SELECT run_id, topic, samples,
   round(average_hz, 6) AS average_hz, round(min_hz, 6) AS min_hz, round(max_hz, 6) AS max_hz, round(std_hz, 6) AS std_hz,
   round(average_ms, 6) AS average_ms, round(min_ms, 6) AS min_ms, round(max_ms, 6) AS max_ms, round(std_ms, 6) AS std_ms,
   round(average_mbps, 6) AS average_mbps, round(min_mbps, 6) AS min_mbps, round(max_mbps, 6) AS max_mbps,
   round(average_messages_per_sec, 6) AS average_messages_per_sec, round(average_mbytes_per_sec, 6) AS average_mbytes_per_sec,
   round(average_kpoints_per_sec, 6) AS average_kpoints_per_sec, round(max_kpoints_per_sec, 6) AS max_kpoints_per_sec,
   round(average_points_per_message, 6) AS average_points_per_message,
   CASE WHEN s.samples = 0 THEN 'No data' WHEN s.average_hz >= 20 THEN 'Excellent' WHEN s.average_hz >= 10 THEN 'Good'
        WHEN s.average_hz >= 5 THEN 'Fair' ELSE 'Poor' END AS performance_rating,
   CASE WHEN s.samples = 0 THEN 'No data' WHEN s.average_ms <= 10 THEN 'Excellent' WHEN s.average_ms <= 25 THEN 'Good'
        WHEN s.average_ms <= 50 THEN 'Fair' ELSE 'Poor' END AS stability_rating,
   coalesce(nullif(array_to_string(list_filter([
     CASE WHEN s.average_hz < 10 THEN 'Consider optimizing point cloud processing to improve frequency' END,
     CASE WHEN s.average_ms > 50 THEN 'High jitter detected - check for system load or network issues' END,
     CASE WHEN s.average_mbps > 100 THEN 'High bandwidth usage - consider data compression or reduced resolution' END],
     lambda x: x IS NOT NULL), '; '), ''), 'System performing within normal parameters') AS recommendations
FROM stream_summary s""",
)

query("stream_summary", STREAM_SUMMARY_SQL)(stream_summary_rated)


# ---------------------------------------------------------------------------------------
# Per-message projections and windows
# ---------------------------------------------------------------------------------------
def _sql(body: str, *extra: str) -> str:
    return O.with_ctes(O.EV, O.MESSAGES, O.RUNS, *extra, body=body)


def _gauges_sql(body: str) -> str:
    return O.with_ctes(O.EV, O.MESSAGES, O.RUNS, O.GAUGES, body=body)


def _ticks_sql(body: str) -> str:
    return O.with_ctes(*O.STREAM_CTES, body=body)


@query("message_size", _sql("SELECT run_id, topic, seq, CASE WHEN data_len > 0 THEN data_len ELSE CAST(width AS BIGINT) * height * point_step END AS size FROM messages"))
def q_message_size(spark, sf):
    return fx.messages(spark, sf).select(*K, "seq", message_size().alias("size"))


@query("point_count", _sql("SELECT run_id, topic, seq, CAST(width AS BIGINT) * height AS points FROM messages"))
def q_point_count(spark, sf):
    return fx.messages(spark, sf).select(*K, "seq", point_count().alias("points"))


@query(
    "convert_units",
    _sql(
        """SELECT run_id, topic, seq, CAST(sz AS DOUBLE) / 1024e0 AS size_kib, CAST(sz AS DOUBLE) / 1e6 AS size_mb,
  CAST(sz AS DOUBLE) / 1048576e0 AS size_mib, CAST(sz AS DOUBLE) / 1073741824e0 AS size_gib,
  CAST(pts AS DOUBLE) / 1000e0 AS kpoints, CAST(pts AS DOUBLE) / 1e6 AS mpoints,
  CAST(sz AS DOUBLE) * 8e0 / 1e6 AS size_megabits
FROM (SELECT *, CASE WHEN data_len > 0 THEN data_len ELSE CAST(width AS BIGINT) * height * point_step END AS sz,
             CAST(width AS BIGINT) * height AS pts FROM messages)"""
    ),
)
def q_convert_units(spark, sf):
    m = fx.messages(spark, sf).select(*K, "seq", message_size().alias("sz"), point_count().alias("pts"))
    return m.select(
        *K,
        "seq",
        convert_units("sz", "bytes_to_kib").alias("size_kib"),
        convert_units("sz", "bytes_to_mb").alias("size_mb"),
        convert_units("sz", "bytes_to_mib").alias("size_mib"),
        convert_units("sz", "bytes_to_gib").alias("size_gib"),
        convert_units("pts", "points_to_k").alias("kpoints"),
        convert_units("pts", "points_to_m").alias("mpoints"),
        convert_units("sz", "bytes_per_s_to_mbps").alias("size_megabits"),
    )


@query(
    "elapsed_seconds",
    _sql("SELECT m.run_id, m.topic, m.seq, CAST(m.arrival_us - r.start_us AS DOUBLE) / 1e6 AS elapsed_s FROM messages m JOIN runs r USING (run_id, topic)"),
)
def q_elapsed_seconds(spark, sf):
    m = fx.messages(spark, sf).join(fx.runs(spark, sf), K)
    return m.select(*K, "seq", elapsed_seconds("arrival_us", "start_us").alias("elapsed_s"))


@query(
    "with_run_context",
    _sql(
        """SELECT m.run_id, m.topic, m.seq, r.start_us, r.duration_s, r.tick_rate_hz,
  max(m.arrival_us) OVER (PARTITION BY m.run_id, m.topic) - r.start_us AS series_max_us
FROM messages m JOIN runs r USING (run_id, topic)"""
    ),
)
def q_with_run_context(spark, sf):
    from tickflow.operators.align import with_run_context

    return with_run_context(fx.messages(spark, sf), fx.runs(spark, sf)).select(
        *K, "seq", "start_us", "duration_s", "tick_rate_hz", "series_max_us"
    )


@query(
    "within_duration",
    _sql(
        """SELECT m.run_id, m.topic, count(*) AS kept, max(m.seq) AS last_seq
FROM messages m JOIN runs r USING (run_id, topic)
WHERE CAST(m.arrival_us - r.start_us AS DOUBLE) / 1e6 < r.duration_s GROUP BY m.run_id, m.topic"""
    ),
)
def q_within_duration(spark, sf):
    kept = rules.within_duration(fx.messages(spark, sf), fx.runs(spark, sf), K)
    return kept.groupBy(*K).agg(F.count(F.lit(1)).alias("kept"), F.max("seq").alias("last_seq"))


@query("inter_arrival", _gauges_sql("SELECT run_id, topic, seq, idx, arrival_us, interval_us FROM gauges"))
def q_inter_arrival(spark, sf):
    return windows.inter_arrival(fx.messages(spark, sf))


@query(
    "last_n_interval_stats",
    _gauges_sql("SELECT run_id, topic, seq, n_intervals, current_hz, jitter_ms, min_interval_ms, max_interval_ms FROM gauges"),
)
def q_last_n_interval_stats(spark, sf):
    return windows.last_n_interval_stats(fx.messages(spark, sf))


@query("last_n_rate_bandwidth", _gauges_sql("SELECT run_id, topic, seq, n_stamps, avg_hz, bandwidth_mbps FROM gauges"))
def q_last_n_rate_bandwidth(spark, sf):
    return windows.last_n_rate_bandwidth(fx.messages(spark, sf))


@query("last_n_message_shape", _gauges_sql("SELECT run_id, topic, seq, avg_message_size_kb, avg_points_per_message FROM gauges"))
def q_last_n_message_shape(spark, sf):
    return windows.last_n_message_shape(fx.messages(spark, sf))


@query("running_totals", _gauges_sql("SELECT run_id, topic, seq, total_messages, total_mb, total_points_millions FROM gauges"))
def q_running_totals(spark, sf):
    return windows.running_totals(fx.messages(spark, sf))


@query(
    "progress_every_k",
    _gauges_sql(
        """SELECT g.run_id, g.topic, g.seq, g.total_messages AS received,
  CASE WHEN g.arrival_us > r.start_us THEN CAST(g.total_messages AS DOUBLE) / (CAST(g.arrival_us - r.start_us AS DOUBLE) / 1e6) END AS rate_hz
FROM gauges g JOIN runs r USING (run_id, topic) WHERE g.total_messages % 10 = 0"""
    ),
)
def q_progress_every_k(spark, sf):
    return windows.progress_every_k(fx.messages(spark, sf), fx.runs(spark, sf), k=10)


# ---------------------------------------------------------------------------------------
# Ticks (J3, W6, W7, F5, F15, P4) and report pieces
# ---------------------------------------------------------------------------------------
@per_session
def _ticks(spark, sf):
    return ticks.tick_metrics(fx.messages(spark, sf), fx.runs(spark, sf))


@query("tick_metrics", _ticks_sql("SELECT * FROM ticks"))
def q_tick_metrics(spark, sf):
    return _ticks(spark, sf)


@query(
    "sample_at_ticks",
    _ticks_sql(
        """SELECT t.run_id, t.topic, t.tick, g.current_hz, g.jitter_ms, g.total_messages, g.arrival_us AS last_arrival_us
FROM tg t LEFT JOIN gauges g ON g.run_id = t.run_id AND g.topic = t.topic AND g.idx = t.cur_idx"""
    ),
)
def q_sample_at_ticks(spark, sf):
    g = windows.message_gauges(fx.messages(spark, sf), with_min_max=False)
    t = ticks.sample_at_ticks(g, fx.runs(spark, sf), cols=["current_hz", "jitter_ms", "total_messages", "arrival_us"])
    return t.select(*K, "tick", "current_hz", "jitter_ms", "total_messages", F.col("arrival_us").alias("last_arrival_us"))


@query("overall_rate", _ticks_sql("SELECT run_id, topic, tick, total_messages, overall_avg_hz, overall_bandwidth_mbps FROM ticks"))
def q_overall_rate(spark, sf):
    return ticks.overall_rate(_ticks(spark, sf))


@query(
    "resettable_throughput",
    _ticks_sql("SELECT run_id, topic, tick, messages_per_second, mbytes_per_second, points_per_second, kpoints_per_second FROM ticks"),
)
def q_resettable_throughput(spark, sf):
    return ticks.resettable_throughput(_ticks(spark, sf))


@query("stream_level", _ticks_sql("SELECT run_id, topic, tick, level, message FROM ticks"))
def q_stream_level(spark, sf):
    return _ticks(spark, sf).select(*K, "tick", "level", "message")


@query("staleness", _ticks_sql("SELECT run_id, topic, tick, CAST(tick_us - last_arrival_us AS DOUBLE) / 1e6 AS stale_s FROM ticks"))
def q_staleness(spark, sf):
    return ticks.staleness(_ticks(spark, sf))


@query(
    "encode_metrics_vector",
    _ticks_sql(
        """SELECT run_id, topic, tick, [coalesce(current_hz, 0e0), coalesce(jitter_ms, 0e0), coalesce(bandwidth_mbps, 0e0),
  coalesce(avg_message_size_kb, 0e0), coalesce(CAST(total_messages AS DOUBLE), 0e0), coalesce(total_mb, 0e0),
  coalesce(messages_per_second, 0e0), coalesce(mbytes_per_second, 0e0), coalesce(kpoints_per_second, 0e0)] AS data
FROM ticks"""
    ),
)
def q_encode_metrics_vector(spark, sf):
    from tickflow.functions.vectors import encode_metrics_vector

    return _ticks(spark, sf).select(*K, "tick", encode_metrics_vector().alias("data"))


_RATED_SQL = O.with_ctes(*O.STREAM_CTES, O.STREAM_SUMMARY, body="{body}")


@query(
    "performance_rating",
    _RATED_SQL.replace(
        "{body}",
        """SELECT run_id, topic, round(average_hz, 6) AS average_hz,
  CASE WHEN average_hz >= 20 THEN 'Excellent' WHEN average_hz >= 10 THEN 'Good' WHEN average_hz >= 5 THEN 'Fair' ELSE 'Poor' END AS performance_rating
FROM stream_summary""",
    ),
)
def q_performance_rating(spark, sf):
    s = stats.stream_summary(summary_ticks(spark, sf))
    return round_doubles(s.select(*K, "average_hz", rules.performance_rating("average_hz").alias("performance_rating")))


@query(
    "stability_rating",
    _RATED_SQL.replace(
        "{body}",
        """SELECT run_id, topic, round(average_ms, 6) AS average_ms,
  CASE WHEN average_ms <= 10 THEN 'Excellent' WHEN average_ms <= 25 THEN 'Good' WHEN average_ms <= 50 THEN 'Fair' ELSE 'Poor' END AS stability_rating
FROM stream_summary""",
    ),
)
def q_stability_rating(spark, sf):
    s = stats.stream_summary(summary_ticks(spark, sf))
    return round_doubles(s.select(*K, "average_ms", rules.stability_rating("average_ms").alias("stability_rating")))


@query(
    "population_std",
    _ticks_sql(
        """SELECT run_id, topic, round(coalesce(stddev_pop(current_hz), 0), 6) AS std_hz,
  round(coalesce(stddev_pop(jitter_ms), 0), 6) AS std_jitter_ms FROM ticks GROUP BY run_id, topic"""
    ),
)
def q_population_std(spark, sf):
    t = summary_ticks(spark, sf)
    return round_doubles(
        t.groupBy(*K).agg(
            stats.population_std(F.col("current_hz")).alias("std_hz"),
            stats.population_std(F.col("jitter_ms")).alias("std_jitter_ms"),
        )
    )


@query(
    "silent_topics",
    _sql(
        """SELECT r.run_id, r.topic, s.second FROM runs r,
  LATERAL (SELECT unnest(range(0, CAST(ceil(r.duration_s) AS BIGINT))) AS second) s
WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.run_id = r.run_id AND m.topic = r.topic
                  AND (m.arrival_us - r.start_us) // 1000000 = s.second)"""
    ),
)
def q_silent_topics(spark, sf):
    from tickflow.operators.align import silent_topics

    return silent_topics(fx.runs(spark, sf), fx.messages(spark, sf), period_s=1)


SILENT_US = 1_000_000


def with_standby(runs: DataFrame) -> DataFrame:
    """The runs' topics, and for each a standby topic that is expected too."""
    return runs.withColumn("topic", F.explode(F.array("topic", F.concat("topic", F.lit("_standby")))))


@query(
    "silences",
    _sql(
        f"""SELECT run_id, topic, from_us, until_us FROM (
  SELECT run_id, topic, coalesce(lag(us) OVER (PARTITION BY run_id, topic ORDER BY us), start_us) AS from_us, us AS until_us FROM (
    SELECT run_id, topic, start_us, arrival_us AS us FROM expected JOIN messages USING (run_id, topic) WHERE arrival_us BETWEEN start_us AND end_us
    UNION ALL SELECT run_id, topic, start_us, end_us FROM expected))
WHERE until_us - from_us >= {SILENT_US}""",
        """expected AS (SELECT run_id, unnest([topic, topic || '_standby']) AS topic, start_us,
    start_us + CAST(duration_s * 1e6 AS BIGINT) AS end_us FROM runs)""",
    ),
)
def q_silences(spark, sf):
    """Stretches without a message; each topic's standby topic is expected too and never sends."""
    from tickflow.operators.align import silences

    return silences(with_standby(fx.runs(spark, sf)), fx.messages(spark, sf), SILENT_US)


@query(
    "tumbling_windows",
    _sql(
        """SELECT run_id, topic, (arrival_us - 1704067200000000) // 1000000 AS window_s, count(*) AS messages,
  CAST(sum(CASE WHEN data_len > 0 THEN data_len ELSE CAST(width AS BIGINT) * height * point_step END) AS BIGINT) AS bytes,
  CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS points
FROM messages GROUP BY ALL"""
    ),
)
def q_tumbling_windows(spark, sf):
    from tickflow.operators.align import tumbling_counts

    return tumbling_counts(fx.messages(spark, sf), fx.BASE_US, 1)


@query(
    "recommendations",
    _RATED_SQL.replace(
        "{body}",
        """SELECT run_id, topic, coalesce(nullif(array_to_string(list_filter([
     CASE WHEN average_hz < 10 THEN 'Consider optimizing point cloud processing to improve frequency' END,
     CASE WHEN average_ms > 50 THEN 'High jitter detected - check for system load or network issues' END,
     CASE WHEN average_mbps > 100 THEN 'High bandwidth usage - consider data compression or reduced resolution' END],
     lambda x: x IS NOT NULL), '; '), ''), 'System performing within normal parameters') AS recommendations
FROM stream_summary""",
    ),
)
def q_recommendations(spark, sf):
    s = stats.stream_summary(summary_ticks(spark, sf))
    recs = rules.recommendations("average_hz", "average_ms", "average_mbps")
    return s.select(*K, F.array_join(recs, "; ").alias("recommendations"))
