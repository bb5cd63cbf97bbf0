"""Sources, sinks and streaming queries. Each writes data derived from the driver's tables to
the session's shared checkpoint folder, runs the source / sink / stream under test, and
returns what it reads back, so the round trip itself is checked."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow.operators import health, report, stats, ticks
from tickflow import schemas as S
from tickflow.plans import oracle as O
from tickflow.plans.registry import ORACLES, QUERIES, query, round_doubles
from tickflow.plans.report_queries import _report
from tickflow.plans.series_queries import CHECKPOINT_S, _series, _series_runs
from tickflow.plans.stream_queries import SILENT_US, with_standby
from tickflow.session import per_session
from tickflow.sources import fixtures as fx
from tickflow.sources import readers, sinks
from tickflow.sources.series_docs import read_long_series_json
from tickflow.streaming import late, live, silence
from tickflow.streaming import ticks as stream_ticks


def _stream_until_done(spark, df, path: str, ckpt: str, mode: str = "append"):
    q = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", ckpt)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(path)


_GAUGE_COLS = "run_id, topic, seq, idx, arrival_us, current_hz, jitter_ms, min_interval_ms, max_interval_ms, avg_hz, bandwidth_mbps, avg_message_size_kb, avg_points_per_message, total_messages, total_mb, total_points_millions"


@query("live_gauges", O.with_ctes(O.EV, O.MESSAGES, O.RUNS, O.GAUGES, body=f"SELECT {_GAUGE_COLS} FROM gauges"))
def q_live_gauges(spark, sf):
    """The stateful stream gauges over the message log replayed as a file stream, in seq order in
    micro-batches of a bounded size: one a run of the stream."""
    src, path, ckpt = (sinks.scratch_path(spark, n) for n in ("messages", "gauges", "gauges-ckpt"))
    for part in _in_cuts(spark, fx.messages(spark, sf), LIVE_ROWS):
        part.write.mode("append").parquet(src)
        stream = readers.read_messages(spark, src, streaming=True)
        out = _stream_until_done(spark, live.live_gauges(stream), path, ckpt)
    return out.select(*[c.strip() for c in _GAUGE_COLS.split(",")])


LIVE_ROWS = 4_000_000  # messages of a micro-batch


def _in_cuts(spark, msgs, rows: int) -> list:
    """``msgs`` in ranges of seq of about ``rows`` rows each. The log is made once and kept by range."""
    cuts = -(-msgs.count() // rows)
    if cuts < 2:
        return [msgs]
    bounds = sorted(set(msgs.approxQuantile("seq", [i / cuts for i in range(1, cuts)], 0.1 / cuts)))
    kept = sinks.scratch_path(spark, "messages-kept")
    cut = sum((F.coalesce((F.col("seq") >= F.lit(int(b))).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
    msgs.withColumn("_cut", cut).write.partitionBy("_cut").parquet(kept)
    whole = spark.read.schema(T.StructType([*msgs.schema.fields, T.StructField("_cut", T.IntegerType())])).parquet(kept)
    return [whole.where(F.col("_cut") == i).drop("_cut") for i in range(len(bounds) + 1)]


LOG_CUTS_S = tuple(range(50, 401, 50))  # the log is written cut by cut, so that files are as old as their rows
FILES_A_TRIGGER, LOG_ROWS = 4, 8_000_000  # of a micro-batch
LOG_WATERMARK = "60 seconds"  # more than a cut: the files of one cut come in any order


def _replayed(spark, log):
    """The log as a stream: made once and kept by cut, then written cut by cut in time order. A cut's
    files are as many as a micro-batch takes, or a multiple for a large cut."""
    src, kept = sinks.scratch_path(spark, "tick-log"), sinks.scratch_path(spark, "tick-log-kept")
    at = F.unix_micros("event_ts") - F.lit(fx.BASE_US)
    cut = sum(((at >= F.lit(c * 1000000)).cast("int") for c in LOG_CUTS_S), F.lit(0))
    log.withColumn("_cut", cut).where("_cut IS NOT NULL").write.partitionBy("_cut").parquet(kept)
    whole = spark.read.schema(T.StructType([*log.schema.fields, T.StructField("_cut", T.IntegerType())])).parquet(kept)
    for cut, n in sorted(whole.groupBy("_cut").count().collect()):
        files = FILES_A_TRIGGER * -(-n // LOG_ROWS)
        whole.where(F.col("_cut") == cut).drop("_cut").coalesce(files).write.mode("append").parquet(src)
    return spark.readStream.schema(stream_ticks.LOG_SCHEMA).option("maxFilesPerTrigger", FILES_A_TRIGGER).parquet(src)


def _tick_stream(spark, sf):
    """X2, X3 over the whole message log."""
    stream = _replayed(spark, stream_ticks.tick_log(fx.messages(spark, sf), fx.runs(spark, sf)))
    out = stream_ticks.tick_metrics_stream(stream, watermark=LOG_WATERMARK)
    return _stream_until_done(spark, out, sinks.scratch_path(spark, "ticks"), sinks.scratch_path(spark, "ticks-ckpt"))


@query("tick_metrics_stream", ORACLES.get("tick_metrics"))
def q_tick_metrics_stream(spark, sf):
    """Every published tick, emitted by event-time timers."""
    return _tick_stream(spark, sf)


@query("resettable_throughput_stream", ORACLES.get("resettable_throughput"))
def q_resettable_throughput_stream(spark, sf):
    """The resettable counters of the ticked stream."""
    return ticks.resettable_throughput(_tick_stream(spark, sf))


@query("silences_stream", ORACLES.get("silences"))
def q_silences_stream(spark, sf):
    """J7 on the replayed log: the stretches that have ended; a standby topic of each never sends."""
    log = stream_ticks.tick_log(fx.messages(spark, sf), with_standby(fx.runs(spark, sf)))
    out = silence.silences_stream(_replayed(spark, log), SILENT_US, LOG_WATERMARK)
    out = _stream_until_done(spark, out, sinks.scratch_path(spark, "silences"), sinks.scratch_path(spark, "silences-ckpt"))
    return out.where("until_us IS NOT NULL")


CUT_US, HELD, DELAY_US = 200_000_000, 13, 10_000_000  # two halves by time; every 13th row comes after both
_BATCHED_SQL = f"""batched AS (SELECT *, arrival_us // 1000000 * 1000000 AS window_start_us,
    CASE WHEN seq % {HELD} = 0 THEN 2 WHEN arrival_us < {fx.BASE_US + CUT_US} THEN 0 ELSE 1 END AS batch FROM messages),
  marked AS (SELECT b.*, (SELECT max(arrival_us) - {DELAY_US} FROM batched e WHERE e.batch < b.batch) AS watermark_us,
    (SELECT max(seq) FROM batched e WHERE e.batch < b.batch AND e.run_id = b.run_id AND e.topic = b.topic) AS last_seq FROM batched b)"""


@per_session
def _late(spark, sf):
    """The message log replayed in three micro-batches, one a run of the stream."""
    src, out, ckpt = (sinks.scratch_path(spark, n) for n in ("late-messages", "late", "late-ckpt"))
    msgs, held, first = fx.messages(spark, sf), F.col("seq") % HELD == 0, F.col("arrival_us") < fx.BASE_US + CUT_US
    for part in (~held & first, ~held & ~first, held):
        msgs.where(part).write.mode("append").parquet(src)
        stream = readers.read_messages(spark, src, streaming=True)
        q = stream.writeStream.foreachBatch(late.late_writer(out, 1, DELAY_US)).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


@query(
    "late_rows",
    O.with_ctes(
        O.EV, O.MESSAGES, _BATCHED_SQL,
        body="""SELECT run_id, topic, seq, arrival_us, watermark_us, 'window_closed' AS reason, batch FROM marked WHERE window_start_us + 1000000 <= watermark_us
UNION ALL SELECT run_id, topic, seq, arrival_us, watermark_us, 'out_of_order', batch FROM marked WHERE seq <= last_seq""",
    ),
)
def q_late_rows(spark, sf):
    """The side table of late rows."""
    return late.late_rows(spark, _late(spark, sf))


@query(
    "late_window_counts",
    O.with_ctes(
        O.EV, O.MESSAGES, _BATCHED_SQL,
        body=f"""SELECT run_id, topic, window_start_us, count(*) AS messages,
  CAST(sum(CASE WHEN data_len > 0 THEN data_len ELSE CAST(width AS BIGINT) * height * point_step END) AS BIGINT) AS bytes,
  CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS points,
  window_start_us + 1000000 <= (SELECT max(arrival_us) - {DELAY_US} FROM messages) AS closed
FROM marked WHERE NOT coalesce(window_start_us + 1000000 <= watermark_us, false) GROUP BY run_id, topic, window_start_us""",
    ),
)
def q_late_window_counts(spark, sf):
    """X4 of the rows in time, beside the side table."""
    return late.window_counts(spark, _late(spark, sf), 1, DELAY_US)


@query(
    "tumbling_rates",
    O.with_ctes(
        O.EV,
        O.MESSAGES,
        body="""SELECT run_id, topic, (arrival_us // 1000000) * 1000000 AS window_start_us, count(*) AS messages,
  CAST(sum(CASE WHEN data_len > 0 THEN data_len ELSE CAST(width AS BIGINT) * height * point_step END) AS BIGINT) AS bytes,
  CAST(sum(CAST(width AS BIGINT) * height) AS BIGINT) AS points
FROM messages GROUP BY run_id, topic, (arrival_us // 1000000) * 1000000""",
    ),
)
def q_tumbling_rates(spark, sf):
    """Windowed counts with a watermark on the replayed stream (append: closed windows), and
    the windows still open when the replay ends."""
    src = sinks.scratch_path(spark, "messages")
    fx.messages(spark, sf).write.parquet(src)
    stream = readers.read_messages(spark, src, streaming=True)
    out = _stream_until_done(spark, live.tumbling_rates(stream, 1, "10 seconds"), sinks.scratch_path(spark, "tumbling"),
                             sinks.scratch_path(spark, "tumbling-ckpt"))
    # the watermark (max event time − 10 s) never passes the last windows of a bounded replay
    out = out.unionByName(live.open_windows(readers.read_messages(spark, src), out).select(*out.columns))
    return out.select("run_id", "topic", F.unix_micros(F.col("window.start")).alias("window_start_us"), "messages", "bytes", "points")


@query("relay_restamp", O.with_ctes(O.EV, O.MESSAGES, O.RUNS, O.GAUGES, body="SELECT run_id, topic, seq, interval_us FROM gauges"))
def q_relay_restamp(spark, sf):
    r = sinks.relay_restamp(fx.messages(spark, sf))
    return r.where(F.col("stamp").isNotNull()).select("run_id", "topic", "seq", "interval_us")


@query(
    "report_json_roundtrip",
    O.with_ctes(
        *O.STREAM_CTES, O.STREAM_SUMMARY, O.SYSTEM_SAMPLES,
        __import__("tickflow.plans.report_queries", fromlist=["REPORT_CTE"]).REPORT_CTE,
        body="SELECT run_id, topic, samples, round(average_hz, 6) AS average_hz, round(cpu_average_percent, 6) AS cpu_average_percent, performance_rating FROM report",
    ),
)
def q_report_json_roundtrip(spark, sf):
    """S10 then S5."""
    path = sinks.scratch_path(spark, "report")
    sinks.write_report(report.nested_report(round_doubles(_report(spark, sf, with_zones=True))), path)
    r = readers.read_report_json(spark, path, lines=True)
    return r.select("run_id", "topic", F.col("metrics.samples").alias("samples"), F.col("metrics.frequency.average_hz").alias("average_hz"),
                    "cpu_average_percent", F.col("summary.performance_rating").alias("performance_rating"))


@query("checkpoints_sink", ORACLES.get("cumulative_checkpoints"))
def q_checkpoints_sink(spark, sf):
    """Cumulative checkpoints appended per (run, checkpoint) folder, read back."""
    path = sinks.scratch_path(spark, "checkpoints")
    c = round_doubles(stats.cumulative_checkpoints(_series(spark, sf), _series_runs(spark, sf), CHECKPOINT_S))
    sinks.write_checkpoints(c, path)
    back = spark.read.parquet(path)
    return back.select("run_id", "series", F.col("checkpoint").cast("long").alias("checkpoint"), "end_us", "is_final", "samples", "valid",
                       "avg", "min", "max", "std", "last_elapsed_us")


@query("thermal_csv_roundtrip", ORACLES.get("thermal_clock_summary"))
def q_thermal_csv_roundtrip(spark, sf):
    """Day CSV files (header, time, temperature, clock) read back by position → A10."""
    path = sinks.scratch_path(spark, "thermal")
    t = fx.thermal_csv(spark, sf).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "temp_c", "arm_hz")
    t.write.option("header", True).csv(path)
    back = readers.read_thermal_csv(spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return round_doubles(health.thermal_clock_summary(back))


@query("log_lines_roundtrip", ORACLES.get("log_pattern_report"))
def q_log_lines_roundtrip(spark, sf):
    """Journal JSON export lines read back → A11."""
    path = sinks.scratch_path(spark, "journal")
    logs = fx.log_lines(spark, sf).select(
        F.col("ts_us").cast("string").alias("__REALTIME_TIMESTAMP"), F.col("priority").cast("string").alias("PRIORITY"),
        F.col("line").alias("MESSAGE"), F.col("line_no").cast("string").alias("__CURSOR"),
    )
    logs.write.json(path)
    return health.log_pattern_report(readers.read_log_lines(spark, path))


DOC_SAMPLES = 5_000


@query(
    "read_series_json",
    O.with_ctes(
        O.EV, O.SERIES,
        body=f"""SELECT series, CAST(idx // {DOC_SAMPLES} AS BIGINT) AS doc, CAST(idx % {DOC_SAMPLES} AS BIGINT) AS idx,
  CAST(trunc(CAST(elapsed_us AS DOUBLE) / 1e6 * 1e6) AS BIGINT) AS elapsed_us, value FROM series""",
    ),
)
def q_read_series_json(spark, sf):
    """The series as JSON documents of bounded length, read back in splits."""
    path, part = sinks.scratch_path(spark, "series-docs"), F.expr(f"idx div {DOC_SAMPLES}")
    points = F.sort_array(F.collect_list(F.struct("idx", (F.col("elapsed_us").cast("double") / 1e6).alias("t"), "value")))
    docs = _series(spark, sf).groupBy("series", part.alias("doc")).agg(points.alias("p"))
    docs.select("series", "doc", F.to_json(F.struct(F.col("p.t").alias("timestamps"), F.col("p.value").alias("hz"))).alias("value")).write.partitionBy("series", "doc").text(path)
    back = read_long_series_json(spark, path)
    folder = "series=([^/]+)/doc=([0-9]+)/"
    return back.select(F.regexp_extract("run_id", folder, 1).alias("series"), F.regexp_extract("run_id", folder, 2).cast("long").alias("doc"), "idx", "elapsed_us", "value")


@query(
    "downsample_in_order",
    f"SELECT *, row_number() OVER (ORDER BY run_id, series, idx) - 1 AS row_no FROM ({ORACLES['minmax_downsample']}) kept",
)
def q_downsample_in_order(spark, sf):
    """T4: the kept points of W14 written in order by several tasks, read back with their places."""
    path, kept = sinks.scratch_path(spark, "kept"), QUERIES["minmax_downsample"](spark, sf)
    sinks.write_in_order(kept, path)
    return sinks.read_in_order(spark, path, kept.schema)


@query("series_snapshot", O.with_ctes(O.EV, O.SERIES, body="SELECT run_id, series, idx, elapsed_us, value FROM series"))
def q_series_snapshot(spark, sf):
    """Whole-series snapshot written twice, the newest read back."""
    path = sinks.scratch_path(spark, "snapshot")
    sinks.write_series_snapshot(_series(spark, sf), path)
    sinks.write_series_snapshot(_series(spark, sf), path)  # a later tick replaces it
    back = sinks.read_snapshot(spark, path, "series string, idx long, elapsed_us long, value double, run_id string", "json")
    return back.select("run_id", "series", "idx", "elapsed_us", "value")


@query(
    "read_samples",
    O.with_ctes(O.EV, O.SYSTEM_VECTORS, body="SELECT run_id, seq, elapsed_us, data FROM system_vectors"),
)
def q_read_samples(spark, sf):
    """Positional vectors of any length written and read back."""
    path = sinks.scratch_path(spark, "vectors")
    fx.system_vectors(spark, sf).select("run_id", "seq", "elapsed_us", "data").write.parquet(path)
    return readers.read_samples(spark, path)


@query(
    "read_diagnostics",
    O.with_ctes(
        O.EV,
        O.DIAGNOSTICS,
        body="""SELECT run_id, ts_us, name, pos, key, value FROM kv
UNION ALL SELECT run_id, ts_us, name, pos, key, value FROM kv WHERE name = 'System Resources'""",
    ),
)
def q_read_diagnostics(spark, sf):
    """The statuses of two producers read as one table; both send the system's."""
    from tickflow.operators.diagnostics import explode_kv

    diag = fx.diagnostics(spark, sf).select(*S.DIAGNOSTICS.fieldNames())
    paths = [sinks.scratch_path(spark, "producer") for _ in range(2)]
    diag.write.parquet(paths[0])
    diag.where(F.col("name") == "System Resources").write.parquet(paths[1])
    return explode_kv(readers.read_diagnostics(spark, paths)).drop("diag_seq")


@query("checkpoints_stream", ORACLES.get("cumulative_checkpoints"))
def q_checkpoints_stream(spark, sf):
    """The series replayed as a file stream; partials kept per micro-batch, rolled up at the end."""
    src, out = sinks.scratch_path(spark, "series"), sinks.scratch_path(spark, "partials")
    series, runs = _series(spark, sf), _series_runs(spark, sf)
    for part in range(3):  # files of samples that are not in order
        series.where(F.col("idx") % 3 == part).write.mode("append").parquet(src)
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = (
        stream.writeStream.foreachBatch(live.checkpoint_writer(out, CHECKPOINT_S, runs=runs))
        .option("checkpointLocation", sinks.scratch_path(spark, "partials-ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return round_doubles(live.rolled_checkpoints(spark, out, runs, CHECKPOINT_S))


@query("latest_labels_stream", ORACLES.get("latest_by_key"))
def q_latest_labels_stream(spark, sf):
    """X7 + X5: latest slot labels maintained by a streaming aggregation over the diagnostics
    replayed as a file stream; each trigger overwrites the snapshot (foreachBatch)."""
    from tickflow.functions.scalars import slot_from_key
    from tickflow.operators.diagnostics import explode_kv, routed

    src = sinks.scratch_path(spark, "diagnostics")
    fx.diagnostics(spark, sf).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    kv = explode_kv(routed(stream, exact=True).where(F.col("route") == "system"), ["run_id", "diag_seq"])
    kv = kv.withColumn("_s", slot_from_key("key")).where(F.col("_s").isNotNull()).select(
        "run_id", F.col("_s.slot").alias("slot"), F.col("_s.field").alias("field"), "value", "ts_us", "diag_seq", "pos"
    )
    out = sinks.scratch_path(spark, "labels")
    q = (
        live.latest_labels(kv).writeStream.outputMode("complete").foreachBatch(live.snapshot_writer(out))
        .option("checkpointLocation", sinks.scratch_path(spark, "labels-ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return sinks.read_snapshot(spark, out, "run_id string, slot int, field string, value string").select("run_id", "slot", "field", "value")
