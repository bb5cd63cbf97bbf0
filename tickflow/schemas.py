"""Table schemas and the fixed values every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the measured system's wire contract and texts for right results)
# ---------------------------------------------------------------------------------------

# Positional metrics vector, in order.
METRICS_VECTOR = [
    "current_hz",
    "jitter_ms",
    "bandwidth_mbps",
    "avg_message_size_kb",
    "total_messages",
    "total_mb",
    "messages_per_second",
    "mbytes_per_second",
    "kpoints_per_second",
]

# All metrics carried in the stream diagnostics, in the order they are produced.
STREAM_KV_METRICS = [
    "current_hz",
    "jitter_ms",
    "min_interval_ms",
    "max_interval_ms",
    "avg_hz",
    "bandwidth_mbps",
    "overall_avg_hz",
    "overall_bandwidth_mbps",
    "total_messages",
    "total_mb",
    "avg_message_size_kb",
    "messages_per_second",
    "mbytes_per_second",
    "points_per_second",
    "kpoints_per_second",
    "avg_points_per_message",
    "total_points_millions",
]

# System vector: 7 base values, then 20 interleaved (memory MB, CPU %) slots, then zones.
SYSTEM_BASE = [
    "cpu_percent",
    "memory_percent",
    "cpu_avg_1min",
    "memory_avg_1min",
    "process_cpu_percent",
    "process_memory_mb",
    "cpu_temp_c",
]
TOP_SLOTS = 20
THERMAL_ZONES = ["cpu", "gpu", "aux", "ao", "pmic", "tboard", "tdiode"]
SYSTEM_VECTOR_MIN_LEN = len(SYSTEM_BASE) + 2 * TOP_SLOTS  # 47

# Diagnostic status names and levels.
STREAM_STATUS_PREFIX = "LiDAR Benchmark"
SYSTEM_STATUS_NAME = "System Resources"
LEVEL_OK, LEVEL_WARN, LEVEL_ERROR = 0, 1, 2

# Status messages.
MSG_LOW_FREQUENCY = "Low frequency detected"
MSG_HIGH_JITTER = "High jitter detected"
MSG_OPERATING_NORMALLY = "Operating normally"
MSG_CPU_CRITICAL = "CPU usage critical"
MSG_CPU_HIGH = "High CPU usage"
MSG_MEMORY_CRITICAL = "Memory usage critical"
MSG_MEMORY_HIGH = "High memory usage"
MSG_SYSTEM_NORMAL = "System resources normal"

# Title line of the console summary block.
TEXT_SUMMARY_TITLE = "LIDAR BENCHMARK SUMMARY"

# Rows of the metrics table: label, report column, unit.
METRICS_TABLE_ROWS = [
    ("Average Frequency", "average_hz", "Hz"),
    ("Min Frequency", "min_hz", "Hz"),
    ("Max Frequency", "max_hz", "Hz"),
    ("Frequency Std Dev", "std_hz", "Hz"),
    ("Average Jitter", "average_ms", "ms"),
    ("Min Jitter", "min_ms", "ms"),
    ("Max Jitter", "max_ms", "ms"),
    ("Jitter Std Dev", "std_ms", "ms"),
    ("Average Bandwidth", "average_mbps", "Mbps"),
    ("Min Bandwidth", "min_mbps", "Mbps"),
    ("Max Bandwidth", "max_mbps", "Mbps"),
    ("Avg Messages/sec", "average_messages_per_sec", "msg/s"),
    ("Avg MB/sec", "average_mbytes_per_sec", "MB/s"),
    ("Avg K Points/sec", "average_kpoints_per_sec", "Kpts/s"),
    ("Max K Points/sec", "max_kpoints_per_sec", "Kpts/s"),
    ("Avg Points/Message", "average_points_per_message", "points"),
    ("Total Samples", "samples", "count"),
]

# Columns of the process table, in order.
PROCESS_TABLE_COLUMNS = [
    "Process #",
    "Process Name",
    "Command Line",
    "Executable Path",
    "Working Dir",
    "Memory Avg (MB)",
    "Memory Min (MB)",
    "Memory Max (MB)",
    "CPU Avg (%)",
    "CPU Min (%)",
    "CPU Max (%)",
]

# Ratings.
RATING_EXCELLENT, RATING_GOOD, RATING_FAIR, RATING_POOR, RATING_NO_DATA = (
    "Excellent",
    "Good",
    "Fair",
    "Poor",
    "No data",
)

# Recommendations, in the order they are checked.
REC_LOW_FREQUENCY = "Consider optimizing point cloud processing to improve frequency"
REC_HIGH_JITTER = "High jitter detected - check for system load or network issues"
REC_HIGH_BANDWIDTH = "High bandwidth usage - consider data compression or reduced resolution"
REC_HIGH_CPU = "High CPU usage - consider performance optimization or hardware upgrade"
REC_HIGH_MEMORY = "High memory usage - check for memory leaks or increase system RAM"
REC_NORMAL = "System performing within normal parameters"

# Health-log failure words (case-insensitive substrings) for the per-pattern report, and
# the narrower list that makes a whole day report unhealthy.
LOG_FAILURE_PATTERNS = [
    "oom",
    "out of memory",
    "watchdog",
    "segfault",
    "backtrace",
    "panic",
    "GPU hang",
    "I/O error",
    "fatal",
    "emergency",
]
HEALTH_VERDICT_PATTERNS = ["oom", "out of memory", "watchdog", "segfault", "panic", "fatal", "emergency"]
BOOT_EVENT_PATTERN = "reboot|shutdown"

# Rating colours for charts; grey when the rating is unknown.
RATING_COLOURS = {
    "Excellent": "#00ff00",
    "Good": "#90EE90",
    "Fair": "#FFD700",
    "Poor": "#FF6B6B",
}
RATING_COLOUR_DEFAULT = "#808080"

# Defaults.
WINDOW_SIZE = 100
TICK_RATE_HZ = 2.0
RESET_SECONDS = 1.0
ROLLING_SAMPLES = 60
RETENTION_POINTS = 3600
CHART_MAX_POINTS = 8000
CMDLINE_MAX_CHARS = 200
PROGRESS_EVERY = 10

# Unit factors (KB = 1024 B, MB = 1e6 B, GB = 2^30 B).
KIB = 1024.0
MB = 1e6
MIB = 1048576.0
GIB = 1073741824.0

# ---------------------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------------------

MESSAGES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("arrival_us", T.LongType()),
        T.StructField("arrival_ts", T.TimestampType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("point_step", T.IntegerType()),
        T.StructField("data_len", T.LongType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("tick_rate_hz", T.DoubleType()),
    ]
)

KV = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

DIAGNOSTICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("message", T.StringType()),
        T.StructField("values", T.ArrayType(KV)),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("elapsed_us", T.LongType()),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)

SERIES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("series", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("elapsed_us", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

THERMAL_CSV = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("temp_c", T.DoubleType()),
        T.StructField("arm_hz", T.DoubleType()),
    ]
)

LOG_LINES = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("line", T.StringType()),
    ]
)
