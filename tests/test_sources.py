"""Readers and sinks on small hand-written files (FIXTURES F8), written to a fresh folder."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickflow.sources import readers, sinks


def _tmp():
    return tempfile.mkdtemp(prefix="tickflow-src-")


def test_read_series_json_lists_of_different_length(spark):
    d = _tmp()
    doc = {
        "timestamps": [0.5, 1.0, 1.5],
        "hz": [10.0, 11.0, 12.0],
        "jitter": [1.0, float("nan"), 3.0],
        "cpu": [50.0, 60.0],  # one value short
        "top_processes_memory": [[1.0, 2.0, 3.0]] + [[0.0, 0.0, 0.0]] * 19,
        "top_processes_cpu": [[5.0, 6.0, 7.0]] * 20,
        "top_processes_names": ["a"] + [""] * 19,
        "top_processes_cmdlines": [""] * 20,
        "top_processes_exes": [""] * 20,
        "top_processes_cwds": [""] * 20,
    }
    with open(os.path.join(d, "series.json"), "w") as f:
        f.write(json.dumps(doc).replace("NaN", "NaN"))
    long = readers.read_series_json(spark, os.path.join(d, "series.json"))
    rows = {(r.series, r.slot, r.idx): (None if r.elapsed_us is None else r.elapsed_us / 1e6, r.value) for r in long.collect()}
    assert rows[("hz", None, 2)] == (1.5, 12.0)
    assert rows[("cpu", None, 1)] == (1.0, 60.0) and ("cpu", None, 2) not in rows
    assert math.isnan(rows[("jitter", None, 1)][1])
    assert rows[("process_memory", 0, 2)] == (1.5, 3.0)
    labels = readers.read_series_labels(spark, os.path.join(d, "series.json")).where(F.col("slot") == 0).first()
    assert labels.name == "a"


def test_read_series_json_missing_file_is_empty(spark):
    assert readers.read_series_json(spark, "/nonexistent/tickflow/series.json").count() == 0


def test_read_report_json_old_keys(spark):
    d = _tmp()
    new = {"run_id": "r", "topic": "t", "metrics": {"samples": 3}, "system_stats": {"cpu": {"average_percent": 40.0}},
           "summary": {"performance_rating": "Good"}}
    old = {"run_id": "r", "topic": "u", "system_resources": {"cpu": {"average_percent": 0.0}, "average_cpu_percent": 33.0},
           "analysis": {"performance_rating": "Fair"}}
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write(json.dumps(new) + "\n" + json.dumps(old) + "\n")
    got = {r.topic: (r.cpu_average_percent, r.summary.performance_rating) for r in readers.read_report_json(spark, d, lines=True).collect()}
    assert got == {"t": (40.0, "Good"), "u": (33.0, "Fair")}


def test_diagnostic_ids_do_not_depend_on_the_splits(spark):
    d = _tmp()
    from tickflow import schemas as S

    rows = [Row(run_id="r", ts_us=7, name="n", level=0, message=f"m{i}", values=[]) for i in range(400)]
    made = spark.createDataFrame(rows, S.DIAGNOSTICS)
    for p in ("p1", "p2"):
        made.repartition(3).write.option("parquet.block.size", 2048).parquet(os.path.join(d, p))
    seen = []
    for split in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            both = readers.read_diagnostics(spark, [os.path.join(d, "p1"), os.path.join(d, "p2")])
            seen.append(sorted((r.diag_seq, r.message) for r in both.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == 800


def test_read_diagnostics_union_and_samples(spark):
    d = _tmp()
    rows = [Row(run_id="r", ts_us=1, name="System Resources", level=0, message="ok", values=[Row(key="a", value="1")])]
    from tickflow import schemas as S

    spark.createDataFrame(rows, S.DIAGNOSTICS).write.parquet(os.path.join(d, "p1"))
    spark.createDataFrame(rows, S.DIAGNOSTICS).write.parquet(os.path.join(d, "p2"))
    both = readers.read_diagnostics(spark, [os.path.join(d, "p1"), os.path.join(d, "p2")])
    assert both.select("diag_seq").distinct().count() == 2
    from tickflow.operators import diagnostics

    assert [r.value for r in diagnostics.explode_kv(both).collect()] == ["1", "1"]
    spark.createDataFrame([Row(run_id="r", seq=1, elapsed_us=5, data=[1.0, 2.0])], S.VECTORS).write.parquet(os.path.join(d, "v"))
    assert readers.read_samples(spark, os.path.join(d, "v")).first().data == [1.0, 2.0]


def test_thermal_csv_empty_day(spark):
    d = _tmp()
    with open(os.path.join(d, "day.csv"), "w") as f:
        f.write("ts,temp,arm\n")
    from tickflow.operators.health import thermal_clock_summary

    assert thermal_clock_summary(readers.read_thermal_csv(spark, d)).count() == 0
    with open(os.path.join(d, "day2.csv"), "w") as f:
        f.write("ts,temp,arm\n2024-05-01 10:00:00,55.5,1500000000\n")
    row = thermal_clock_summary(readers.read_thermal_csv(spark, d)).first()
    assert (row.avg_temp_c, row.max_arm_hz) == (55.5, 1.5e9)


def test_readers_feed_the_operators(spark):
    """Series, reports and journal lines as their tools write them, through the operators."""
    from tickflow.operators import health, report, stats, windows

    d = _tmp()
    with open(os.path.join(d, "series.json"), "w") as f:
        json.dump({"timestamps": [0.5 * i for i in range(30)], "hz": [10.0 + i % 3 for i in range(30)], "cpu": [50.0] * 30}, f, indent=2)
    series = readers.read_series_json(spark, os.path.join(d, "series.json"))
    by = {r.series: r for r in stats.nan_safe_stats(series).collect()}
    assert (by["hz"].samples, by["hz"].avg, by["cpu"].max) == (30, 11.0, 50.0)
    assert {r.series for r in stats.series_stats(series).collect()} == {"hz", "cpu"}
    runs = series.select("run_id", "series").distinct().withColumn("duration_s", F.lit(14.5))
    final = stats.cumulative_checkpoints(series, runs, 5.0).where("is_final and series = 'hz'").first()
    assert (final.samples, final.avg) == (30, 11.0)
    assert windows.minmax_downsample(series.drop("slot"), 8).count() > 0
    doc = {"start_time": "2024-05-01T10:00:00", "duration_seconds": 60.0,
           "metrics": {"samples": 3, "frequency": {"average_hz": 10.5}, "throughput": {"average_messages_per_sec": 2.0}},
           "system_stats": {"samples": 4, "cpu": {"average_percent": 40.0}}, "summary": {"performance_rating": "Good", "recommendations": ["x"]}}
    os.makedirs(os.path.join(d, "r"))
    with open(os.path.join(d, "r", "report.json"), "w") as f:
        json.dump(doc, f, indent=2)
    flat = readers.flat_report(readers.read_report_json(spark, os.path.join(d, "r")))
    assert [r.value for r in report.metrics_overview(flat).orderBy("ord").collect()] == [10.5, 0.0, 0.0, 0.0, 2.0]
    assert "  Average: 10.50 Hz" in report.text_summary(flat).first().text
    for table in (report.summary_table, report.run_info_table, report.metrics_table, report.system_table, report.performance_targets, report.run_metadata):
        assert table(flat).count() > 0
    os.makedirs(os.path.join(d, "j"))
    with open(os.path.join(d, "j", "day.json"), "w") as f:
        f.write(json.dumps({"__REALTIME_TIMESTAMP": "1714557600000000", "PRIORITY": "3", "MESSAGE": "system reboot", "__CURSOR": "s=1"}) + "\n")
    assert health.boot_events(readers.read_log_lines(spark, os.path.join(d, "j"))).count() == 1


def test_large_and_long_values(spark):
    """No cut, no saturation: 80 trailing zones; 1e13 through the published rounding."""
    from tickflow.functions.scalars import fixed_text
    from tickflow.functions.vectors import decode_system_vector
    from tickflow.operators.stats import stream_summary

    v = spark.createDataFrame([Row(data=[float(i) for i in range(127)])])
    assert v.select(decode_system_vector("data").alias("d")).first().d.zones == [float(i) for i in range(47, 127)]
    cols = ("current_hz", "jitter_ms", "bandwidth_mbps", "messages_per_second", "mbytes_per_second", "kpoints_per_second", "avg_points_per_message")
    t = spark.createDataFrame([Row(run_id="r", topic="t", **dict.fromkeys(cols, 1e13))])
    assert stream_summary(t).first().average_hz == 1e13
    texts = spark.createDataFrame([(x,) for x in (0.005, -0.004, 12.345, -1.5, 1e17, float("nan"), float("inf"))], "x double")
    assert [r.t for r in texts.select(fixed_text("x", 2).alias("t")).collect()] == ["0.01", "0.00", "12.35", "-1.50", "100000000000000000.00", "nan", "inf"]


def test_checkpoints_end_with_the_run(spark):
    """A sample after the run's end counts nowhere; a large offset keeps its variance."""
    from tickflow.operators.stats import cumulative_checkpoints

    s = spark.createDataFrame([("r", "s", i, t * 1000000, v) for i, (t, v) in enumerate([(5, 1e9), (15, 1e9 + 1), (50, 99.0)])], "run_id string, series string, idx bigint, elapsed_us bigint, value double")
    runs = spark.createDataFrame([("r", "s", 40.0)], "run_id string, series string, duration_s double")
    final = cumulative_checkpoints(s, runs, 20.0).where("is_final").first()
    assert (final.samples, final.max, final.last_elapsed_us, final.std) == (2, 1e9 + 1, 15000000, 0.5)


def test_a_report_takes_hosts_together(spark):
    from tickflow.operators.report import build_report

    stream = spark.createDataFrame([("r", t, 5, 12.0, 5.0, 1.0) for t in ("a", "b")], "run_id string, topic string, samples int, average_hz double, average_ms double, average_mbps double")
    runs = spark.createDataFrame([("r", t, 0, 60.0) for t in ("a", "b")], "run_id string, topic string, start_us bigint, duration_s double")
    system = spark.createDataFrame([("r", "h0", 1, 10.0, 10.0, 10.0, 50.0, 50.0, 50.0), ("r", "h1", 3, 50.0, 90.0, 20.0, 10.0, 10.0, 10.0)], "run_id string, host string, samples bigint, cpu_average_percent double, cpu_max_percent double, cpu_min_percent double, memory_average_percent double, memory_max_percent double, memory_min_percent double")
    zones = spark.createDataFrame([("r", h, "gpu", 2, 40.0 + i, 50.0, 30.0) for i, h in enumerate(("h0", "h1"))], "run_id string, host string, zone string, samples bigint, average_celsius double, max_celsius double, min_celsius double")
    rows = build_report(stream, system, runs, None, zones).collect()
    assert len(rows) == 2 and {(r.cpu_average_percent, r.cpu_max_percent, r.cpu_min_percent, r.system_samples) for r in rows} == {(40.0, 90.0, 10.0, 4)}
    assert rows[0].jetson_temperatures["gpu"].average_celsius == 40.5


def test_sinks_skip_empty_and_append(spark):
    d = _tmp()
    empty = spark.createDataFrame([], "run_id string, checkpoint long, v double")
    sinks.write_checkpoints(empty, os.path.join(d, "c"))
    assert not [x for x in os.listdir(os.path.join(d, "c")) if x.startswith("run_id=")]
    assert sinks.write_series_snapshot(spark.createDataFrame([], "run_id string, v double"), os.path.join(d, "s")) is False
    one = spark.createDataFrame([Row(run_id="r", checkpoint=1, v=1.0)])
    assert sinks.write_checkpoints(one, os.path.join(d, "c"))
    assert sinks.write_checkpoints(one.withColumn("checkpoint", F.lit(2).cast("long")), os.path.join(d, "c"))
    assert spark.read.parquet(os.path.join(d, "c")).count() == 2
    assert sinks.write_checkpoints(one, os.path.join(d, "c"))  # again: replaced, not doubled
    assert spark.read.parquet(os.path.join(d, "c")).count() == 2


def test_snapshots_are_seen_whole_or_not_at_all(spark, tmp_path):
    """A write that fails half way leaves the snapshot before; an empty one isn't published;
    the version before the newest stays for its readers."""
    from tickflow.sources import sinks

    path, schema = str(tmp_path / "snap"), "id long, v long"
    read = lambda: sorted(tuple(r) for r in sinks.read_snapshot(spark, path, schema).collect())
    table = lambda n, v: spark.range(n).select("id", F.lit(v).cast("long").alias("v"))
    assert read() == []
    assert sinks.write_snapshot(table(5, 1), path) and read() == [(i, 1) for i in range(5)]
    held = sinks.read_snapshot(spark, path, schema)
    broken = spark.range(0, 40, 1, 4).select("id", F.when(F.col("id") == 35, F.raise_error(F.lit("lost"))).otherwise(F.lit(2)).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_snapshot(broken, path)
    assert read() == [(i, 1) for i in range(5)]
    assert not sinks.write_snapshot(table(0, 3), path) and read() == [(i, 1) for i in range(5)]
    assert sinks.write_snapshot(table(3, 4), path) and read() == [(i, 4) for i in range(3)]
    assert held.count() == 5
    for v in (5, 6, 7):
        assert sinks.write_snapshot(table(2, v), path) and read() == [(0, v), (1, v)]
    assert not sinks.write_series_snapshot(spark.createDataFrame([], "run_id string, value double"), str(tmp_path / "none"))


def test_files_are_numbered_without_dealing_their_rows(spark, capsys):
    """Rows joined with the number of their file stay where they are read, however large their file."""
    from tickflow import schemas as S
    from tickflow.sources import places, sinks

    d = _tmp()
    rows = [Row(run_id="r", ts_us=i, name="n", level=0, message="m", values=[]) for i in range(50)]
    spark.createDataFrame(rows, S.DIAGNOSTICS).write.parquet(os.path.join(d, "p1"))
    spark.createDataFrame([(str(i),) for i in range(50)], "value string").write.text(os.path.join(d, "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = places.with_file_number(places.pieces(spark, os.path.join(d, "t")))
        in_order = sinks.read_in_order(spark, os.path.join(d, "p1"), S.DIAGNOSTICS)
        for df in (readers.read_diagnostics(spark, [os.path.join(d, "p1")] * 2), numbered, in_order):
            df.explain()
            plan = capsys.readouterr().out
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
