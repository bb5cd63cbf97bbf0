"""Readers whose rows don't depend on how the files are split: journal lines, long documents, ordered output."""

import json
import os
import random
import tempfile
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tickflow.sources import readers
from tickflow.sources.series_docs import read_long_series_json


@contextmanager
def splits_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_numbers_do_not_depend_on_the_splits(spark):
    d = tempfile.mkdtemp(prefix="tickflow-lines-")
    want = {}
    for no, name in enumerate(("a.json", "b.json")):
        with open(os.path.join(d, name), "w") as f:
            for i in range(500):
                if i % 50 == 7:
                    f.write("\n")  # counts, gives no row
                    continue
                f.write(json.dumps({"__REALTIME_TIMESTAMP": "1700000000000000", "PRIORITY": str(i % 8), "MESSAGE": f"{name} {'x' * (i % 40)} {i}", "__CURSOR": f"{no}-{i}"}) + "\n")
                want[f"{no}-{i}"] = (no << 40) + i
    for size in ("128m", "3k"):
        with splits_of(spark, size):
            rows = readers.read_log_lines(spark, d)
            assert {r.cursor: r.line_no for r in rows.collect()} == want
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write("not json\n")
    bad = [r for r in readers.read_log_lines(spark, d).collect() if r.cursor is None]
    assert [(r.line_no, r.line) for r in bad] == [(2 << 40, None)]


def _doc(n, rnd):
    def num():
        return rnd.choice([rnd.random() * 100, float(rnd.randrange(50)), -1.5e-7, float("nan"), None])

    texts = ['plain', 'a, b', '[kworker/0:1]', '"quoted", "hz": [1, 2]', 'back\\slash\\', '{"cpu": [9]}', '', 'ü,"']
    return {
        "note": 'first, "hz": [7',
        "timestamps": [0.25 * i for i in range(n)],
        "hz": [num() for _ in range(n)],
        "jitter": [],
        "bandwidth": [num() for _ in range(n + 3)],
        "top_processes_cmdlines": [rnd.choice(texts) for _ in range(20)],
        "cpu": [num() for _ in range(max(0, n - 2))],
        "top_processes_memory": [[num() for _ in range(n)] for _ in range(4)] + [[]] + [[1.0]],
        "top_processes_names": [rnd.choice(texts) for _ in range(20)],
        "top_processes_cpu": [[], [num() for _ in range(n)]],
        "unknown": [[1], [2, 3]],
        "temperature": None,
    }


@pytest.mark.parametrize("indent", [None, 2])
def test_long_documents_equal_the_whole_reader(spark, indent):
    """Splits of some 400 bytes cut strings, nested lists and numbers."""
    d, rnd = tempfile.mkdtemp(prefix="tickflow-docs-"), random.Random(7)
    for i, n in enumerate((200, 0, 1, 37)):
        with open(os.path.join(d, f"run {i}.json"), "w") as f:
            json.dump(_doc(n, rnd), f, indent=indent, ensure_ascii=bool(i % 2))

    def rows(df):
        return sorted(map(repr, df.collect()))

    want = rows(readers.read_series_json(spark, d))
    assert len(want) > 1500
    for size in ("128m", "400b"):
        with splits_of(spark, size):
            got = read_long_series_json(spark, d)
            assert got.dtypes == readers.read_series_json(spark, d).dtypes
            assert rows(got) == want


def test_a_long_document_is_read_by_many_tasks(spark):
    d = tempfile.mkdtemp(prefix="tickflow-long-")
    n = 40_000
    with open(os.path.join(d, "one.json"), "w") as f:
        json.dump({"timestamps": [i / 10 for i in range(n)], "hz": [i / 7 for i in range(n)]}, f)
    with splits_of(spark, "100k"):
        from tickflow.sources import places

        assert places.pieces(spark, d, ",").select(F.spark_partition_id()).distinct().count() >= 8
        got = read_long_series_json(spark, d)
        assert got.agg(F.count("*"), F.count_distinct("idx"), F.max("elapsed_us")).first()[:] == (n, n, (n - 1) * 100_000)
        assert got.where(F.abs(F.col("value") - F.col("idx") / 7) > 1e-9).count() == 0


def test_long_documents_missing_file_is_empty(spark):
    got = read_long_series_json(spark, "/nonexistent/tickflow/series.json")
    assert got.count() == 0 and got.columns == ["run_id", "series", "slot", "idx", "elapsed_us", "value"]


def test_points_written_in_order_by_several_tasks(spark):
    """T4: files read in name order are in (run, series, time) order, a third of all rows in one series."""
    from tickflow.sources import sinks

    out = tempfile.mkdtemp(prefix="tickflow-order-")
    rows = [("r", "hot" if i % 3 else f"s{i % 7}", (i * 7919) % 10_007, i, None if i % 5 == 0 else float(i)) for i in range(9000)]
    points = spark.createDataFrame(rows, "run_id string, series string, idx long, elapsed_us long, value double")
    sinks.write_in_order(points, out, parts=6)
    names = sorted(f for f in os.listdir(out) if f.endswith(".parquet"))
    assert len(names) == 6
    one_by_one = [r for f in names for r in spark.read.parquet(os.path.join(out, f)).select("run_id", "series", "idx").toPandas().itertuples(index=False, name=None)]
    assert one_by_one == sorted((r[0], r[1], r[2]) for r in rows)
    hot = [f for f in names if spark.read.parquet(os.path.join(out, f)).where("series = 'hot'").count()]
    assert len(hot) >= 3
    for size in ("128m", "4k"):
        with splits_of(spark, size):
            back = sinks.read_in_order(spark, out, points.schema).orderBy("row_no").collect()
            assert [r.row_no for r in back] == list(range(9000)) and [(r.run_id, r.series, r.idx) for r in back] == one_by_one
    sinks.write_in_order(points.limit(0), out)
    assert sinks.read_in_order(spark, out, points.schema).count() == 0


def test_run_metadata_reads_the_written_report(spark):
    """The report is made once: what the query returns comes from the sink's files, not from the tables."""
    from tickflow.plans import report_queries

    from conftest import SF_SMALL

    out = report_queries.q_run_metadata(spark, SF_SMALL)
    assert out.count() > 0 and not any("events" in f for f in out.inputFiles())
