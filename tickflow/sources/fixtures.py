"""Projections of the driver's read-only tables onto the telemetry inputs (FIXTURES.md).

Every table here is derived by Spark from ``events`` so its size grows with the data. The
same projections are written in DuckDB SQL in :mod:`tickflow.plans.oracle` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.operators.scale import dense_index
from tickflow.session import per_session, prepare

# ---------------------------------------------------------------------------------------
# Fixed values of the projection (FIXTURES.md)
# ---------------------------------------------------------------------------------------
BASE_US = 1704067200000000  # 2024-01-01 00:00:00 UTC in µs
COMPRESSION = {"signup": 6480, "click": 12960, "view": 25920, "purchase": 51840, "error": 207360}
RUN_SECONDS = 2592000  # 30 days
TICK_RATE_HZ = 2.0
ODD_VALUES = ["nan", "inf", "1.0d", "1_000", " 12 ", "", "x", "1e5"]
LOG_PHRASES = [
    "kernel: Out of memory: Killed",
    "room ready",
    "watchdog: BUG",
    "app Segfault at 0",
    "backtrace follows",
    "PANIC now",
    "gpu hang detected",
    "I/O error sda",
    "Fatal: x",
    "emergency mode",
    "reboot system boot",
    "all good",
]
RUN_ID = "run-1"
HOUR_US = 3600 * 1000000


@per_session
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events table plus the derived columns every projection uses, computed once
    per row: ``k`` (from the JSON props), ``cents`` and ``us``."""
    prepare(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "*",
        F.get_json_object(F.col("props"), "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"),
    )


def us_col(ts: str = "ts") -> Column:
    """µs since the epoch of a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def k_col() -> Column:
    return F.col("k")


def cents_col() -> Column:
    return F.col("cents")


def compression_col(topic: str = "event_type") -> Column:
    expr = None
    for name, c in COMPRESSION.items():
        cond = F.col(topic) == name
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr.cast("long")


def _arrival_us() -> Column:
    """Exact integer division of the µs offset by the topic's compression factor."""
    factor = " ".join(f"WHEN '{t}' THEN {c}" for t, c in COMPRESSION.items())
    return F.expr(
        f"{BASE_US} + (timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) - {BASE_US})"
        f" div (CASE event_type {factor} END)"
    )


@per_session
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point-cloud message log, one row per message."""
    e = events(spark, sf_dir)
    width = (F.lit(10) * (k_col() + 1)).cast("int")
    arrival = _arrival_us()
    return e.select(
        F.lit(RUN_ID).alias("run_id"),
        F.col("event_type").alias("topic"),
        F.col("event_id").alias("seq"),
        arrival.alias("arrival_us"),
        F.timestamp_micros(arrival).alias("arrival_ts"),
        width.alias("width"),
        F.lit(16).alias("height"),
        F.lit(16).alias("point_step"),
        F.when(F.col("event_id") % 7 == 0, F.lit(0).cast("long"))
        .otherwise(width.cast("long") * 16 * 16 + 64)
        .alias("data_len"),
    )


@per_session
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per (run, topic): start, configured duration and tick rate."""
    topics = events(spark, sf_dir).select(F.col("event_type").alias("topic")).distinct()
    return topics.select(
        F.lit(RUN_ID).alias("run_id"),
        "topic",
        F.lit(BASE_US).cast("long").alias("start_us"),
        (F.lit(float(RUN_SECONDS)) / compression_col("topic")).alias("duration_s"),
        F.lit(TICK_RATE_HZ).alias("tick_rate_hz"),
    )


ZONE_COLS = [f"zone_{z}_millic" for z in ("cpu", "gpu", "aux", "ao", "pmic", "tboard", "tdiode")]


@per_session
def system_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host samples at 1 Hz, one host per event type."""
    e = events(spark, sf_dir).withColumn("host", F.col("event_type"))
    e = e.withColumn("run_id", F.lit(RUN_ID))
    indexed = dense_index(e, ["run_id", "host"], "event_id", idx_col="_i")
    k = k_col()
    zones = []
    for zone_no, name in enumerate(ZONE_COLS):
        missing = ((F.col("event_id") + zone_no) % 3 == 0) | (F.col("event_id") % 15 == 0)
        zones.append(F.when(missing, F.lit(None)).otherwise(F.lit(40000) + 100 * k + 500 * zone_no).cast("long").alias(name))
    sensors = F.array(
        F.struct(F.lit("coretemp").alias("grp"), F.lit("CPU 0").alias("label"), (F.lit(40.0) + k / 10.0).alias("current")),
        F.struct(F.lit("coretemp").alias("grp"), F.lit("Core 1").alias("label"), F.lit(41.0).alias("current")),
        F.struct(F.lit("cpu_thermal").alias("grp"), F.lit("").alias("label"), (F.lit(39.0) + k / 10.0).alias("current")),
    )
    return indexed.select(
        "run_id",
        "host",
        (F.col("_i") + 1).alias("sample_seq"),
        (F.lit(BASE_US) + (F.col("_i") + 1) * 1000000).alias("sample_us"),
        F.least(F.col("value"), F.lit(100.0)).alias("cpu_percent"),
        k.cast("double").alias("memory_percent"),
        (F.col("event_id") % 5).cast("int").alias("cpu_count"),
        *zones,
        sensors.alias("sensors"),
    )


@per_session
def process_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per-process rows per host sample (h0: 4-hour samples, h1: 1-hour samples)."""
    e = events(spark, sf_dir).select("user_id", us_col().alias("us"), cents_col().alias("cents"))
    hosts = []
    for host, bucket in (("h0", 4 * HOUR_US), ("h1", HOUR_US)):
        hosts.append(
            e.groupBy(F.expr(f"(us - {BASE_US}) div {bucket}").alias("sample_seq"), "user_id")
            .agg(F.sum("cents").alias("_cents"), F.count(F.lit(1)).alias("_n"))
            .withColumn("host", F.lit(host))
        )
    g = hosts[0].unionByName(hosts[1])
    pid = F.col("user_id") + 100
    name = F.when(pid % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), (pid % 7).cast("string")))
    return g.select(
        F.lit(RUN_ID).alias("run_id"),
        "host",
        "sample_seq",
        pid.alias("pid"),
        name.alias("name"),
        (F.expr("_cents div 1000") * 1048576).alias("rss_bytes"),
        (F.lit(12.5) * F.col("_n")).alias("cpu_percent"),
        F.repeat(F.concat(name, F.lit(" --flag ")), 40).alias("cmdline"),
        F.concat(F.lit("/usr/bin/"), name).alias("exe"),
        F.concat(F.lit("/home/"), F.col("user_id").cast("string")).alias("cwd"),
    )


@per_session
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """diagnostic statuses with key/value lists (duplicate keys and odd numbers included)."""
    e = events(spark, sf_dir)
    k = k_col()
    name = (
        F.when(F.col("event_id") % 3 == 0, F.lit("LiDAR Benchmark: /t"))
        .when(F.col("event_id") % 3 == 1, F.lit("System Resources"))
        .otherwise(F.lit("Other"))
    )
    odd = F.element_at(F.array(*[F.lit(v) for v in ODD_VALUES]), (k % 8 + 1).cast("int"))

    def kv(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    values = F.array(
        kv("current_hz", cents_col()),
        kv("jitter_ms", k),
        kv("top_process_1_name", F.lit("a")),
        kv("top_process_1_name", F.concat(F.lit("p"), F.col("user_id").cast("string"))),
        kv("jetson_gpu_temp_c", k),
        kv("odd", odd),
    )
    return e.select(
        F.lit(RUN_ID).alias("run_id"),
        F.col("event_id").alias("diag_seq"),
        us_col().alias("ts_us"),
        name.alias("name"),
        F.lit(0).alias("level"),
        F.lit("ok").alias("message"),
        values.alias("values"),
    )


@per_session
def metrics_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional metrics vectors, cut to 6 values on every 13th event."""
    e = events(spark, sf_dir)
    k = k_col().cast("double")
    v = F.col("value")
    full = F.array(v, k, v * 2, F.lit(1.5), F.col("event_id").cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), v * 3)
    e = e.withColumn("_full", full)
    data = F.when(F.col("event_id") % 13 == 0, F.slice(F.col("_full"), 1, 6)).otherwise(F.col("_full"))
    return e.select(
        F.lit(RUN_ID).alias("run_id"),
        F.col("event_type").alias("host"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 500000).alias("elapsed_us"),
        data.alias("data"),
    )


@per_session
def system_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional system vectors: 7 base + 20 interleaved slots + 7 zones = 54 values,
    cut to 47, 46, 7, 6 or 0 values when ``event_id % 17`` is 1..5, and with 80 zones when it is 6."""
    e = events(spark, sf_dir)
    k = k_col().cast("double")
    v = F.col("value")
    base = [F.least(v, F.lit(100.0)), k, v / 2, k / 2, k % 10, v * 3, F.lit(40.0) + k / 10]
    slots = []
    for i in range(20):
        slots += [v + i, k + i]
    zones = [F.lit(40.0 + z) + k / 10 for z in range(7)]
    full = F.array(*base, *slots, *zones)
    m = F.col("event_id") % 17
    cut = (
        F.when(m == 1, F.lit(47)).when(m == 2, F.lit(46)).when(m == 3, F.lit(7)).when(m == 4, F.lit(6)).when(m == 5, F.lit(0))
    )
    e = e.withColumn("_full", full).withColumn("_cut", cut)
    full, cut = F.col("_full"), F.col("_cut")
    many = F.concat(full, F.array_repeat(v + F.lit(0.5), 73))
    data = F.when(m == 6, many).when(cut.isNull(), full).when(cut == 0, F.array().cast("array<double>")).otherwise(F.slice(full, 1, cut))
    return e.select(
        F.lit(RUN_ID).alias("run_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 500000).alias("elapsed_us"),
        data.alias("data"),
    )


@per_session
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recorded series in long form, one series per event type; every 11th value NaN."""
    e = events(spark, sf_dir).select(
        F.lit(RUN_ID).alias("run_id"), F.col("event_type").alias("series"), F.col("event_id").alias("seq"), _arrival_us().alias("arrival_us"), "value"
    )
    indexed = dense_index(e, ["run_id", "series"], "seq")
    return indexed.select(
        "run_id",
        "series",
        "idx",
        (F.col("arrival_us") - F.lit(BASE_US)).alias("elapsed_us"),
        F.when(F.col("seq") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )


@per_session
def thermal_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day rows of temperature and ARM clock."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("temp_c"),
        (F.lit(1.5e9) + k_col() * F.lit(1e6)).alias("arm_hz"),
        F.to_date(F.col("ts")).alias("day"),
    )


@per_session
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines with priority."""
    e = events(spark, sf_dir)
    k = k_col()
    phrase = F.element_at(F.array(*[F.lit(p) for p in LOG_PHRASES]), (k % 12 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("line_no"),
        F.col("ts").cast("timestamp").alias("ts"),
        us_col().alias("ts_us"),
        F.to_date(F.col("ts")).alias("day"),
        (k % 8).cast("int").alias("priority"),
        phrase.alias("line"),
    )
