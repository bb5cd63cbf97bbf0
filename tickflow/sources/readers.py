"""Sources (S1-S7): explicit schemas, no inference; batch or streaming where it applies."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickflow import schemas as S
from tickflow.sources import places as P


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def read_messages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Message log rows (D1) from parquet; ``streaming=True`` gives a file stream."""
    return _reader(spark, streaming).schema(S.MESSAGES).parquet(path)


def read_samples(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Positional metric / system vectors (``data array<double>``)."""
    return _reader(spark, streaming).schema(S.VECTORS).parquet(path)


def read_diagnostics(spark: SparkSession, paths: list[str], streaming: bool = False) -> DataFrame:
    """S3: diagnostic statuses of several producers fanned into one table (duplicates kept).
    ``diag_seq`` names a status: the number of its file (in the order of producers and file names)
    and its row there, however the files are split into tasks; on a stream, its time."""
    frames = [_reader(spark, streaming).schema(S.DIAGNOSTICS).parquet(p) for p in paths]
    if streaming:
        return reduce(DataFrame.unionByName, frames).withColumn("diag_seq", F.col("ts_us"))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = reduce(DataFrame.unionByName, [f.select("*", F.lit(i).alias("_producer"), *place) for i, f in enumerate(frames)])
    files = rows.select("_producer", "_file").distinct()  # a row a file
    files = files.withColumn("_no", F.row_number().over(Window.orderBy("_producer", "_file")).cast("long") - 1)
    seq = F.col("_no") * F.lit(1 << P.FILE_ROW_BITS) + F.col("_row")
    # the table of files goes to the rows: dealt by file, a large file's rows would meet in one task
    return rows.join(F.broadcast(files), ["_producer", "_file"]).select(*S.DIAGNOSTICS.fieldNames(), seq.alias("diag_seq"))


SERIES_DOC = T.StructType(
    [
        T.StructField("timestamps", T.ArrayType(T.DoubleType())),
        *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("hz", "jitter", "bandwidth", "throughput", "cpu", "memory", "temperature")],
        T.StructField("top_processes_memory", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("top_processes_cpu", T.ArrayType(T.ArrayType(T.DoubleType()))),
        *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("top_processes_names", "top_processes_cmdlines", "top_processes_exes", "top_processes_cwds")],
    ]
)
SERIES_NAMES = ["hz", "jitter", "bandwidth", "throughput", "cpu", "memory", "temperature"]


SERIES_ROWS = "run_id string, series string, slot int, idx bigint, elapsed_us bigint, value double"


def _series_docs(spark: SparkSession, path: str) -> DataFrame | None:
    """The documents with ``run_id`` (the file's path), None if there is no file."""
    try:
        docs = spark.read.schema(SERIES_DOC).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return docs.withColumn("run_id", F.input_file_name())


def read_series_json(spark: SparkSession, path: str) -> DataFrame:
    """Recorded-series documents (parallel lists) → the long rows that the series operators take,
    ``(run_id, series, slot, idx, elapsed_us, value)``; the slot is null but for process series.
    Lists may differ in length (a value without a timestamp keeps a NULL time). A missing file
    gives an empty table. A document is parsed once and its lists zipped with its timestamps."""
    docs = _series_docs(spark, path)
    if docs is None:
        return spark.createDataFrame([], SERIES_ROWS)

    def lists(name: str, col, slot) -> Column:
        return F.struct(F.lit(name).alias("series"), slot.cast("int").alias("slot"), col.alias("vals"))

    def per_slot(column: str, name: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<array<double>>")), lambda v, i: lists(name, v, i))

    flat = F.array(*[lists(n, F.col(n), F.lit(None)) for n in SERIES_NAMES])
    slots = F.concat(per_slot("top_processes_memory", "process_memory"), per_slot("top_processes_cpu", "process_cpu"))
    rows = docs.select("run_id", "timestamps", F.explode(F.concat(flat, slots)).alias("s"))
    rows = rows.select("run_id", "timestamps", "s.series", "s.slot", F.posexplode("s.vals").alias("idx", "value"))
    elapsed = (F.get("timestamps", F.col("idx")) * F.lit(1e6)).cast("bigint")
    return rows.select("run_id", "series", "slot", F.col("idx").cast("bigint").alias("idx"), elapsed.alias("elapsed_us"), "value")


def read_series_labels(spark: SparkSession, path: str) -> DataFrame:
    """The slot label lists of a series document → (run_id, slot, name, cmdline, exe, cwd)."""
    docs = _series_docs(spark, path)
    if docs is None:
        return spark.createDataFrame([], "run_id string, slot int, name string, cmdline string, exe string, cwd string")
    z = F.arrays_zip("top_processes_names", "top_processes_cmdlines", "top_processes_exes", "top_processes_cwds")
    return docs.select("run_id", F.posexplode(z).alias("slot", "l")).select(
        "run_id", "slot", F.col("l.top_processes_names").alias("name"), F.col("l.top_processes_cmdlines").alias("cmdline"),
        F.col("l.top_processes_exes").alias("exe"), F.col("l.top_processes_cwds").alias("cwd"),
    )


_CPU = T.StructType([T.StructField(n, T.DoubleType()) for n in ("average_percent", "max_percent", "min_percent")])
_TEMP = T.StructType([T.StructField(n, T.DoubleType()) for n in ("average_celsius", "max_celsius", "min_celsius")])
_SYSTEM = T.StructType(
    [
        T.StructField("samples", T.LongType()),
        T.StructField("cpu", _CPU),
        T.StructField("memory", _CPU),
        T.StructField("temperature", _TEMP),
        T.StructField("jetson_temperatures", T.MapType(T.StringType(), _TEMP)),
        T.StructField("average_cpu_percent", T.DoubleType()),
        T.StructField("average_memory_percent", T.DoubleType()),
    ]
)
_SUMMARY = T.StructType(
    [
        T.StructField("performance_rating", T.StringType()),
        T.StructField("stability_rating", T.StringType()),
        T.StructField("recommendations", T.ArrayType(T.StringType())),
    ]
)
REPORT_DOC = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("samples", T.LongType()),
                    T.StructField("frequency", T.StructType([T.StructField(n, T.DoubleType()) for n in ("average_hz", "min_hz", "max_hz", "std_hz")])),
                    T.StructField("jitter", T.StructType([T.StructField(n, T.DoubleType()) for n in ("average_ms", "min_ms", "max_ms", "std_ms")])),
                    T.StructField("bandwidth", T.StructType([T.StructField(n, T.DoubleType()) for n in ("average_mbps", "min_mbps", "max_mbps")])),
                    T.StructField(
                        "throughput",
                        T.StructType(
                            [
                                T.StructField(n, T.DoubleType())
                                for n in ("average_messages_per_sec", "average_mbytes_per_sec", "average_kpoints_per_sec", "max_kpoints_per_sec", "average_points_per_message")
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("system_stats", _SYSTEM),
        T.StructField("system_resources", _SYSTEM),
        T.StructField("summary", _SUMMARY),
        T.StructField("analysis", _SUMMARY),
    ]
)


def read_report_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Run reports with the old key names tolerated: ``system_resources`` for
    ``system_stats``, ``analysis`` for ``summary``, and the flat average CPU / memory used when
    the nested average is 0 or missing. A file holds one report (indented or not) or, with
    ``lines``, one per line. A report that names no run or topic goes by its file's path."""
    r = spark.read.schema(REPORT_DOC).option("multiLine", not lines).json(path)
    r = r.withColumns({"run_id": F.coalesce("run_id", F.input_file_name()), "topic": F.coalesce("topic", F.lit(""))})
    sysb = F.coalesce(F.col("system_stats"), F.col("system_resources"))
    summ = F.coalesce(F.col("summary"), F.col("analysis"))

    def avg_or_flat(nested: str, flat: str):
        v = sysb[nested]["average_percent"]
        return F.when(F.coalesce(v, F.lit(0.0)) == 0, F.coalesce(sysb[flat], v)).otherwise(v)

    return r.select(
        "run_id",
        "topic",
        "start_time",
        "end_time",
        "duration_seconds",
        "metrics",
        sysb.alias("system_stats"),
        avg_or_flat("cpu", "average_cpu_percent").alias("cpu_average_percent"),
        avg_or_flat("memory", "average_memory_percent").alias("memory_average_percent"),
        summ.alias("summary"),
    )


def flat_report(reports: DataFrame) -> DataFrame:
    """The rows of :func:`read_report_json` with the columns that the report tables take (those of
    ``operators.report.build_report``)."""
    m, sysb = F.col("metrics"), F.col("system_stats")
    fields = {"frequency": ("average_hz", "min_hz", "max_hz", "std_hz"), "jitter": ("average_ms", "min_ms", "max_ms", "std_ms"), "bandwidth": ("average_mbps", "min_mbps", "max_mbps")}
    fields["throughput"] = tuple(f.name for f in reports.schema["metrics"].dataType["throughput"].dataType.fields)
    cols = [m[block][name].alias(name) for block, names in fields.items() for name in names]
    for block, what in (("cpu", "percent"), ("memory", "percent"), ("temperature", "celsius")):
        for f in ("average", "max", "min"):
            if not (f == "average" and what == "percent"):
                cols.append(sysb[block][f"{f}_{what}"].alias(f"{block}_{f}_{what}"))
    return reports.select(
        "run_id", "topic", F.to_timestamp("start_time").alias("start_time"), F.to_timestamp("end_time").alias("end_time"), "duration_seconds",
        m["samples"].alias("samples"), *cols, "cpu_average_percent", "memory_average_percent", sysb["samples"].alias("system_samples"),
        sysb["jetson_temperatures"].alias("jetson_temperatures"), "summary.performance_rating", "summary.stability_rating", "summary.recommendations",
    )


def read_thermal_csv(spark: SparkSession, path: str) -> DataFrame:
    """Day files of temperature and ARM clock; header skipped; the second and
    third fields are the values."""
    return spark.read.schema(S.THERMAL_CSV).option("header", True).csv(path).select(
        F.to_timestamp("ts").alias("ts"), "temp_c", "arm_hz", F.to_date(F.to_timestamp("ts")).alias("day")
    )


LOG_JSON = T.StructType(
    [
        T.StructField("__REALTIME_TIMESTAMP", T.StringType()),
        T.StructField("PRIORITY", T.StringType()),
        T.StructField("MESSAGE", T.StringType()),
        T.StructField("__CURSOR", T.StringType()),
    ]
)


def read_log_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Journal export lines (one JSON object per line, the journal's own field names).
    ``line_no`` names a line by its file (in the order of names) and its number there, from 0, however
    the files are split into tasks; on a stream it is its time. Empty lines count but give no row; a
    line that isn't JSON is a row of nulls."""
    if streaming:
        raw = spark.readStream.schema(LOG_JSON).json(path).withColumn("_line_no", F.col("__REALTIME_TIMESTAMP").cast("long"))
    else:
        lines = P.with_file_number(P.numbered(P.pieces(spark, path))).where(F.trim("value") != "")
        no = F.col("_no") * F.lit(1 << P.FILE_ROW_BITS) + F.col("place")
        raw = lines.select(F.from_json("value", LOG_JSON).alias("_l"), no.alias("_line_no")).select("_l.*", "_line_no")
    us = F.col("__REALTIME_TIMESTAMP").cast("long")
    return raw.select(
        F.col("__CURSOR").alias("cursor"),
        F.col("_line_no").alias("line_no"),
        us.alias("ts_us"),
        F.timestamp_micros(us).alias("ts"),
        F.date_format(F.timestamp_micros(us), "yyyy-MM-dd").alias("day"),
        F.col("PRIORITY").cast("int").alias("priority"),
        F.col("MESSAGE").alias("line"),
    )
