"""Golden unit tests on hand-written edge rows (FIXTURES F10) and model checks of the scale
utilities against plain single-partition windows / a pure-Python sequential model."""

import math
import random

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tickflow.functions import rules
from tickflow.functions.vectors import decode_metrics_vector, decode_system_vector
from tickflow.operators import scale, stats, ticks, windows

B = 1_700_000_000_000_000


def _msgs(spark, arrivals, topic="t", data_len=100):
    rows = [Row(run_id="r", topic=topic, seq=i, arrival_us=a, width=10, height=16, point_step=16, data_len=data_len)
            for i, a in enumerate(arrivals)]
    return spark.createDataFrame(rows)


def _runs(spark, duration_s, topic="t", rate=2.0):
    return spark.createDataFrame([Row(run_id="r", topic=topic, start_us=B, duration_s=float(duration_s), tick_rate_hz=rate)])


# --- ratings, levels, recommendations ------------------------------------------------------
@pytest.mark.parametrize("hz,exp", [(20.0, "Excellent"), (19.999, "Good"), (10.0, "Good"), (9.99, "Fair"), (5.0, "Fair"), (4.99, "Poor")])
def test_performance_rating_edges(spark, hz, exp):
    assert spark.range(1).select(rules.performance_rating(F.lit(hz)).alias("r")).first().r == exp


@pytest.mark.parametrize("ms,exp", [(10.0, "Excellent"), (10.01, "Good"), (25.0, "Good"), (50.0, "Fair"), (50.01, "Poor")])
def test_stability_rating_edges(spark, ms, exp):
    assert spark.range(1).select(rules.stability_rating(F.lit(ms)).alias("r")).first().r == exp


def test_no_data_rating(spark):
    r = spark.range(1).select(rules.performance_rating(F.lit(0.0), F.lit(False)).alias("r")).first().r
    assert r == "No data"


@pytest.mark.parametrize(
    "cpu,mem,level,msg",
    [(70.0, 95.0, 2, "Memory usage critical"), (70.1, 95.0, 1, "High CPU usage"), (90.0, 10.0, 1, "High CPU usage"),
     (90.1, 10.0, 2, "CPU usage critical"), (75.0, 95.0, 1, "High CPU usage"), (10.0, 70.0, 0, "System resources normal")],
)
def test_system_level_order(spark, cpu, mem, level, msg):
    r = spark.range(1).select(rules.system_level(F.lit(cpu), F.lit(mem)).alias("l")).first().l
    assert (r.level, r.message) == (level, msg)


def test_recommendations(spark):
    r = spark.range(1).select(rules.recommendations(F.lit(5.0), F.lit(60.0), F.lit(1.0), F.lit(None), F.lit(None)).alias("x")).first().x
    assert r == ["Consider optimizing point cloud processing to improve frequency",
                 "High jitter detected - check for system load or network issues"]
    r = spark.range(1).select(rules.recommendations(F.lit(50.0), F.lit(1.0), F.lit(1.0), F.lit(10.0), F.lit(10.0)).alias("x")).first().x
    assert r == ["System performing within normal parameters"]


# --- vectors --------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 6, 7, 46, 47, 54])
def test_system_vector_lengths(spark, n):
    data = [float(i) for i in range(n)]
    d = spark.createDataFrame([Row(data=data)], "data array<double>").select(decode_system_vector("data").alias("d")).first().d
    if n < 7:
        assert all(math.isnan(d[c]) for c in ("cpu_percent", "cpu_temp_c"))
    else:
        assert d.cpu_percent == 0.0 and d.cpu_temp_c == 6.0
    if n < 47:
        assert all(math.isnan(s.memory_mb) for s in d.slots)
    else:
        assert d.slots[0].memory_mb == 7.0 and d.slots[19].cpu_percent == 46.0
    assert len(d.zones) == max(0, n - 47)


def test_metrics_vector_short(spark):
    df = spark.createDataFrame([Row(data=[1.0] * 6)], "data array<double>")
    nan = df.select(decode_metrics_vector("data", "nan").alias("m")).first().m
    skip = df.select(decode_metrics_vector("data", "skip").alias("m")).first().m
    assert math.isnan(nan.current_hz) and skip.current_hz is None


# --- message gauges ---------------------------------------------------------------------------
def _model(arrivals, n):
    """Pure-Python sequential model of the collector deques."""
    out, ts, iv = [], [], []
    for a in arrivals:
        if ts:
            iv.append(a - ts[-1])
        ts.append(a)
        ts, iv = ts[-n:], iv[-n:]
        hz = jit = None
        if iv:
            m = sum(iv) / len(iv)
            hz = math.inf if m == 0 else 1e6 / m
            jit = math.sqrt(sum((x - m) ** 2 for x in iv) / len(iv)) / 1000
        span = ts[-1] - ts[0]
        out.append((hz, jit, (len(ts) * 1e6 / span) if span > 0 else None, min(iv) / 1000 if iv else None, max(iv) / 1000 if iv else None))
    return out


@pytest.mark.parametrize("count", [1, 2, 5, 6, 7, 40])
def test_gauges_match_model_small_blocks(spark, count):
    rnd = random.Random(count)
    arr, t = [], B
    for _ in range(count):
        t += rnd.choice([0, 1000, 50_000, 100_000, 2_000_000])
        arr.append(t)
    n = 5
    plain = windows.message_gauges(_msgs(spark, arr), n).orderBy("seq").collect()
    # tiny buckets and blocks exercise the halo and the bucket offsets
    blocked = windows.message_gauges(_msgs(spark, arr), n, block_rows=n, bucket_width=3).orderBy("seq").collect()
    model = _model(arr, n)
    assert len(plain) == len(blocked) == count
    for p, b, m in zip(plain, blocked, model):
        for col in ("current_hz", "jitter_ms", "avg_hz", "min_interval_ms", "max_interval_ms", "total_bytes"):
            assert p[col] == b[col] or (p[col] is not None and b[col] is not None and math.isclose(p[col], b[col]))
        hz, jit, avg_hz, mn, mx = m
        if hz is None:
            assert p.current_hz is None
        else:
            assert math.isclose(p.current_hz, hz, rel_tol=1e-12) or (math.isinf(hz) and math.isinf(p.current_hz))
            assert math.isclose(p.jitter_ms, jit, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(p.min_interval_ms, mn) and math.isclose(p.max_interval_ms, mx)
        assert (p.avg_hz is None and avg_hz is None) or math.isclose(p.avg_hz, avg_hz, rel_tol=1e-12)


def test_zero_interval_gives_inf(spark):
    g = windows.message_gauges(_msgs(spark, [B, B, B]), 100).orderBy("seq").collect()
    assert g[0].current_hz is None and math.isinf(g[1].current_hz) and g[1].avg_hz is None


def test_dense_index_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [Row(k=rnd.choice("ab"), seq=s, v=rnd.randint(0, 9)) for s in rnd.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows)
    got = scale.dense_index(df, ["k"], "seq", bucket_width=64, cumulative=["v"]).select("k", "seq", "idx", "cum_v")
    w = Window.partitionBy("k").orderBy("seq")
    exp = df.select("k", "seq", (F.row_number().over(w) - 1).alias("idx"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_v"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_sliding_min_max_brute_force(spark):
    rnd = random.Random(5)
    vals = [rnd.randint(0, 100) for _ in range(97)]
    df = spark.createDataFrame([Row(g=1, idx=i, v=v) for i, v in enumerate(vals)])
    n = 7
    got = scale.sliding_min_max(df, ["g"], "idx", "v", n, min_col="mn", max_col="mx").orderBy("idx").collect()
    for r in got:
        frame = vals[max(0, r.idx - n + 1): r.idx + 1]
        assert (r.mn, r.mx) == (min(frame), max(frame))


# --- ticks: reset rule against the sequential rule -------------------------------------------
def _tick_model(arrivals, start, step, n_ticks, reset_us):
    out, last_reset, cnt, seen, i_msg = [], 0, 0, 0, 0
    for i in range(1, n_ticks + 1):
        now = start + i * step
        while i_msg < len(arrivals) and arrivals[i_msg] <= now:
            cnt += 1
            seen += 1
            i_msg += 1
        if seen < 2:
            continue
        win = (i - last_reset) * step
        out.append((i, cnt / (win / 1e6)))
        if win >= reset_us:
            last_reset, cnt = i, 0
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_resettable_throughput_model(spark, seed):
    rnd = random.Random(seed)
    arr, t = [], B + rnd.randint(0, 3_000_000)
    for _ in range(60):
        t += rnd.choice([10_000, 300_000, 700_000, 1_500_000])
        arr.append(t)
    dur = 40.0
    got = ticks.tick_metrics(_msgs(spark, arr), _runs(spark, dur), n=10).select("tick", "messages_per_second").orderBy("tick").collect()
    model = _tick_model(arr, B, 500_000, int(dur * 2), 1_000_000)
    assert [r.tick for r in got] == [m[0] for m in model]
    for r, m in zip(got, model):
        assert math.isclose(r.messages_per_second, m[1], rel_tol=1e-12)


def test_dead_stream_freezes_gauges(spark):
    arr = [B + 100_000 * i for i in range(1, 6)]
    got = ticks.tick_metrics(_msgs(spark, arr), _runs(spark, 10.0), n=10).orderBy("tick").collect()
    assert got[-1].current_hz == got[2].current_hz == 10.0
    assert got[-1].messages_per_second == 0.0


@pytest.mark.parametrize("block", [3])
def test_tiny_tick_blocks_equal_the_default(spark, block):
    """Gauges, first published tick and resets carried over many block edges."""
    rnd = random.Random(block)
    arr, t = [], B + 700_000
    for _ in range(50):
        t += rnd.choice([10_000, 400_000, 900_000, 6_000_000])
        arr.append(t)
    msgs, runs = _msgs(spark, arr), _runs(spark, 70.0)
    for reset in (1.0, 5.0):
        want = ticks.tick_metrics(msgs, runs, n=5, reset_s=reset).orderBy("tick").collect()
        got = ticks.tick_metrics(msgs, runs, n=5, reset_s=reset, block=block, block_rows=10, bucket_width=7).orderBy("tick").collect()
        assert got == want and len(want) > 100
    g = windows.message_gauges(msgs, 5)
    assert ticks.sample_at_ticks(g, runs, block=block).orderBy("tick").collect() == ticks.sample_at_ticks(g, runs).orderBy("tick").collect()


def test_long_grid_comes_from_many_tasks(spark):
    """A topic with three messages in 14 days: its ticks are made in more than one partition."""
    msgs, runs = _msgs(spark, [B + 100_000, B + 200_000, B + 86_400_000_000 * 9]), _runs(spark, 14 * 86_400.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = ticks.tick_metrics(msgs, runs, n=5)
        parts = t.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(p.n for p in parts) == 14 * 86_400 * 2 and len(parts) > 3


# --- series operators --------------------------------------------------------------------------
def _series(spark, values, name="s"):
    return spark.createDataFrame([Row(run_id="r", series=name, idx=i, elapsed_us=i * 1_000_000, value=float(v)) for i, v in enumerate(values)])


def test_nan_only_series(spark):
    r = stats.nan_safe_stats(_series(spark, [math.nan] * 4)).first()
    assert (r.valid, r.avg, r.min, r.max, r.std) == (0, 0.0, 0.0, 0.0, 0.0)
    r = stats.series_stats(_series(spark, [1.0, math.nan])).first()
    assert math.isnan(r.avg) and math.isnan(r.min)


@pytest.mark.parametrize("length,kept", [(8000, 8000), (8001, None)])
def test_downsample_threshold(spark, length, kept):
    df = spark.range(length).select(F.lit("r").alias("run_id"), F.lit("s").alias("series"), F.col("id").alias("idx"),
                                     (F.col("id") * 1000).alias("elapsed_us"), F.sin(F.col("id").cast("double")).alias("value"))
    out = windows.minmax_downsample(df, 8000).count()
    if kept:
        assert out == kept
    else:
        assert out <= 8000 and out >= 4000


def test_array_split_bins(spark):
    # 11 points in 4 bins → sizes 3,3,3,2 (max_points = 8 → 4 bins); every bin keeps its min and max
    vals = [5, 1, 9, 2, 8, 3, 7, 4, 6, 0, 10]
    df = _series(spark, vals)
    got = sorted(r.idx for r in windows.minmax_downsample(df, 8).collect())
    bins = [range(0, 3), range(3, 6), range(6, 9), range(9, 11)]
    exp = set()
    for b in bins:
        seg = [(vals[i], i) for i in b]
        exp.add(min(seg)[1])
        exp.add(min(seg, key=lambda x: (-x[0], x[1]))[1])
    assert got == sorted(exp)


def test_first_seen_zero_reentry(spark):
    rows = [Row(run_id="r", host="h", sample_seq=s, pid=7, cpu_percent=50.0) for s in (1, 2, 4)]
    got = windows.first_seen_zero(spark.createDataFrame(rows)).orderBy("sample_seq").collect()
    assert [r.cpu_percent_reported for r in got] == [0.0, 50.0, 0.0]


def test_top_n_ties_lower_pid(spark):
    rows = [Row(run_id="r", host="h", sample_seq=1, pid=p, rss_bytes=100) for p in (5, 3, 9)]
    got = windows.top_n_per_sample(spark.createDataFrame(rows), 2).orderBy("rank").collect()
    assert [r.pid for r in got] == [3, 5]


@pytest.mark.parametrize("mx,unit", [(3599, "seconds"), (3600, "hours"), (86399, "hours"), (86400, "days")])
def test_time_axis(spark, mx, unit):
    from tickflow.functions.scalars import time_axis_unit

    assert spark.range(1).select(time_axis_unit(F.lit(mx)).alias("u")).first().u == unit


def test_checkpoints_exact_multiple(spark):
    s = _series(spark, [1, 2, 3, 4, 5, 6])
    runs = spark.createDataFrame([Row(run_id="r", series="s", duration_s=4.0)])
    got = stats.cumulative_checkpoints(s, runs, 2.0).orderBy("checkpoint").collect()
    assert [(r.checkpoint, r.samples, r.is_final) for r in got] == [(1, 3, False), (2, 5, True)]


def test_parse_kv_last_wins(spark):
    from tickflow.operators.diagnostics import parse_kv

    d = spark.createDataFrame(
        [Row(run_id="r", diag_seq=1, ts_us=1, name="System Resources", level=0, message="",
             values=[Row(key="a", value="1"), Row(key="a", value="x"), Row(key="b", value=" 12 "), Row(key="c", value="1.0d")])]
    )
    got = {r.key: (r.num, r.text) for r in parse_kv(d).collect()}
    assert got == {"a": (None, "x"), "b": (12.0, None), "c": (None, "1.0d")}


def test_thermal_all_negative_day(spark):
    from tickflow.operators.health import thermal_clock_summary

    df = spark.createDataFrame([Row(day="d", temp_c=-5.0, arm_hz=-1.0), Row(day="d", temp_c=-3.0, arm_hz=-2.0)])
    r = thermal_clock_summary(df).first()
    assert r.max_temp_c == 0.0 and r.avg_temp_c == -4.0


# --- more tick edges (FIXTURES F10) ------------------------------------------------------------
def test_message_on_tick_instant_is_seen(spark):
    # messages exactly at tick 1 and tick 2 instants: tick 2 sees both → first published tick is 2
    arr = [B + 500_000, B + 1_000_000]
    got = ticks.tick_metrics(_msgs(spark, arr), _runs(spark, 3.0), n=10).orderBy("tick").collect()
    assert got[0].tick == 2 and got[0].total_messages == 2


def test_first_messages_after_several_ticks(spark):
    arr = [B + 3_200_000 + i * 100_000 for i in range(3)]
    got = ticks.tick_metrics(_msgs(spark, arr), _runs(spark, 6.0), n=10).orderBy("tick").collect()
    # messages at 3.2, 3.3, 3.4 s all belong to tick 7 (3.5 s), the first tick with >= 2 messages;
    # no reset happened before it, so its throughput spans the 3.5 s since the run start
    assert got[0].tick == 7 and got[0].total_messages == 3
    assert math.isclose(got[0].messages_per_second, 3 / 3.5)
    # tick 7 spans >= 1 s, so it resets (R0 = 7); tick 8 counts the 0.5 s since then: no messages
    assert got[1].tick == 8 and got[1].messages_per_second == 0.0


def test_wall_clock_stepping_back(spark):
    # arrival order is the sequence; a clock step back gives a negative interval, as in the source
    arr = [B, B + 100_000, B + 50_000, B + 150_000]
    g = windows.message_gauges(_msgs(spark, arr), 3).orderBy("seq").collect()
    assert [r.interval_us for r in g] == [None, 100_000, -50_000, 100_000]
    assert math.isclose(g[3].current_hz, 3 * 1e6 / 150_000)


# --- J1 against the sequential acceptance rule ------------------------------------------------
def _zip_model(metric_times, sys_times):
    events = sorted([(t, 0, i) for i, t in enumerate(metric_times)] + [(t, 1, i) for i, t in enumerate(sys_times)])
    seen, acc, pairs = 0, 0, []
    for t, kind, i in events:
        if kind == 0:
            seen += 1
        elif acc < seen:
            acc += 1
            pairs.append((acc, sorted(metric_times)[acc - 1], i))
    return pairs


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_positional_zip_model(spark, seed):
    from tickflow.operators.align import positional_zip

    rnd = random.Random(seed)
    mt = sorted(rnd.sample(range(0, 100_000_000, 7), 40))
    st = sorted(rnd.sample(range(1, 100_000_000, 11), 50))
    m = spark.createDataFrame([Row(run_id="r", seq=i, elapsed_us=t) for i, t in enumerate(mt)])
    s = spark.createDataFrame([Row(run_id="r", seq=i, elapsed_us=t) for i, t in enumerate(st)])
    got = sorted((r.k, r.metrics_time, r.sys_seq) for r in positional_zip(m, s, block_us=8).collect())
    assert got == _zip_model(mt, st)


def test_silences_in_blocks(spark):
    """Equal to a walk over each topic, whatever the blocks; a topic that never sent is silent throughout."""
    import random

    from tickflow.operators.align import silences

    rnd = random.Random(3)
    runs = [("r", "a", 1000, 0.01), ("r", "b", 1000, 0.01), ("r", "never", 1000, 0.01)]
    sent = [("r", t, rnd.randrange(0, 12_500)) for t in "ab" for _ in range(40)] + [("r", "a", 5000)] * 3 + [("r", "unknown", 2000)]
    want = []
    for run, topic, start, duration in runs:
        end = start + int(duration * 1e6)
        marks = [start, *sorted(at for _, t, at in sent if t == topic and start <= at <= end), end]
        want += [(run, topic, x, y) for x, y in zip(marks, marks[1:]) if y - x >= 300]
    expected = spark.createDataFrame(runs, "run_id string, topic string, start_us long, duration_s double")
    msgs = spark.createDataFrame(sent, "run_id string, topic string, arrival_us long")
    for block in (7, 450, 10**9):
        got = silences(expected, msgs, 300, block_us=block).select("run_id", "topic", "from_us", "until_us").collect()
        assert sorted(map(tuple, got)) == sorted(want), block
    assert ("r", "never", 1000, 11000) in want
