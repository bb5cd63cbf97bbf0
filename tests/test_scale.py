"""Block mode = plain mode on the driver's data: the scale utilities with tiny buckets and
blocks (many halo copies, many bucket offsets, many carry-ins) give the same rows as the
defaults, where every topic fits one block."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickflow.operators import align, scale, windows
from tickflow.sources import fixtures as fx

from conftest import SF_SMALL


def _same(a, b):
    cols = sorted(a.columns)
    assert a.count() == b.count()
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_gauges_small_blocks_equal_default(spark):
    m = fx.messages(spark, SF_SMALL).cache()
    default = windows.message_gauges(m, 100).drop("block")
    tiny = windows.message_gauges(m, 100, block_rows=100, bucket_width=37).drop("block")
    _same(default, tiny)


def test_rolling_mean_small_blocks(spark):
    s = fx.system_samples(spark, SF_SMALL).cache()
    _same(windows.rolling_mean_samples(s, n=60), windows.rolling_mean_samples(s, n=60, block_rows=64, bucket_width=16))


def test_asof_small_blocks(spark):
    m = fx.messages(spark, SF_SMALL).select("run_id", "topic", "seq", "arrival_us").cache()
    s = fx.system_samples(spark, SF_SMALL).where("host = 'view'").cache()
    big = align.align_asof(m, s, ["run_id"], "arrival_us", "sample_us", ["sample_seq"])
    small = align.align_asof(m, s, ["run_id"], "arrival_us", "sample_us", ["sample_seq"], block_us=700_000)
    _same(big, small)


def test_asof_ties_and_input_order(spark):
    """Several right rows at one instant: the greatest wins, whatever the order of the input; nulls and a
    tolerance."""
    from pyspark.sql import Row

    left = [Row(k="a", t=t, name=i) for i, t in enumerate([5, 10, 10, 11, 40, 99])] + [Row(k=None, t=10, name=90), Row(k="a", t=None, name=91), Row(k="b", t=3, name=92)]
    right = [Row(k="a", u=10, v=x) for x in (3, 9, 4)] + [Row(k="a", u=20, v=1), Row(k="a", u=None, v=50), Row(k=None, u=1, v=60), Row(k="b", u=4, v=7)]
    want = {0: None, 1: 9, 2: 9, 3: 9, 4: 1, 5: 1, 90: None, 91: None, 92: None}
    for turn in (1, -1):
        for block in (7, 1000):
            got = align.align_asof(spark.createDataFrame(left[::turn]), spark.createDataFrame(right[::turn]).repartition(3), ["k"], "t", "u", ["v"], block_us=block)
            assert {r.name: r.r_v for r in got.collect()} == want
    got = align.align_asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", ["v"], tolerance_us=20)
    assert {r.name: r.r_v for r in got.collect()} == want | {5: None}


def test_zip_small_blocks_equal_default(spark):
    rnd = __import__("random").Random(3)
    rows = [[(("x" if rnd.random() < 0.7 else "y"), t, i) for i, t in enumerate(sorted(rnd.randrange(3000) for _ in range(400)))] for _ in range(2)]
    m, s = (spark.createDataFrame(r, "run_id string, elapsed_us long, seq long") for r in rows)
    want = align.positional_zip(m, s)
    assert want.count() > 300
    for block in (1, 50, 1000):
        _same(want, align.positional_zip(m, s, block_us=block))


def test_blocked_carry_forward_equals_window(spark):
    df = spark.range(0, 3000).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 17 == 0, F.col("id")).alias("v")
    )
    got = scale.blocked_carry_forward(df, ["k"], "o", "v", block_width=50)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("k", "o", F.last("v", ignorenulls=True).over(w).alias("v"))
    _same(got.select("k", "o", "v"), exp)


def test_blocked_running_sum_equals_window(spark):
    df = spark.range(0, 2000).select((F.col("id") % 4).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("x"))
    got = scale.blocked_running_sum(df, ["k"], "o", ["x"], block_width=33)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("k", "o", "x", F.sum("x").over(w).alias("run_x"))
    _same(got.select("k", "o", "x", "run_x"), exp)


def test_live_window_blocks_equal_the_whole(spark):
    """Blocks of a few rows give the means of one window over the whole series, a hot series and NaNs included."""
    rows = [("r", s, i, i * 300_000, float("nan") if i % 9 == 4 else float(i * 37 % 101)) for s, n in (("hot", 900), ("few", 3), ("one", 1)) for i in range(n)]
    series = spark.createDataFrame(rows, "run_id string, series string, idx long, elapsed_us long, value double")
    got = {(r.series, r.idx): r.mean_value for r in windows.live_window(series, 60, rate_hz=1, block_rows=7).collect()}
    by = {}
    for _, s, i, us, v in rows:
        by.setdefault(s, []).append((us, v))
    want = {}
    for s, points in by.items():
        for i, (us, _) in enumerate(points):
            if us >= max(0, points[-1][0] - 60_000_000):
                frame = [v for _, v in points[max(0, i - 59) : i + 1] if v == v]
                want[s, i] = sum(frame) / len(frame)
    assert got == want and len(got) > 200
    wide = windows.live_window(series, 60, rate_hz=1)
    assert {(r.series, r.idx): r.mean_value for r in wide.collect()} == want
