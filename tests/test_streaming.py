"""Batch = stream: the stateful last-N gauges fed file by file equal the batch operator."""

import os
import tempfile

from pyspark.sql import functions as F

from tickflow.operators import windows
from tickflow.sources import fixtures as fx
from tickflow.streaming import live

from conftest import SF_SMALL


def test_live_gauges_multi_batch(spark):
    msgs = fx.messages(spark, SF_SMALL).cache()
    base = tempfile.mkdtemp(prefix="tickflow-stream-")
    src = os.path.join(base, "src")
    # three files written one after the other, in seq order, one micro-batch each
    bounds = [0, 2000, 4000, 10**9]
    for i in range(3):
        msgs.where((F.col("seq") >= bounds[i]) & (F.col("seq") < bounds[i + 1])).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (live.live_gauges(stream, 100).writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(base, "out"))
    assert got.agg(F.max("late_messages")).first()[0] == 0
    got = got.drop("late_messages")
    exp = windows.message_gauges(msgs, 100).select(*got.columns)
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0


def test_live_gauges_count_late_rows(spark):
    """Rows that come after later ones of their topic join no gauge but are counted."""
    msgs = fx.messages(spark, SF_SMALL).where("topic = 'view'").orderBy("seq").limit(60).cache()
    base = tempfile.mkdtemp(prefix="tickflow-late-")
    src = os.path.join(base, "src")
    order = [r.seq for r in msgs.select("seq").orderBy("seq").collect()]
    early, late, rest = order[10:40], order[:10], order[40:]
    for part in (early, late, rest):
        msgs.where(F.col("seq").isin(part)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(msgs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (live.live_gauges(stream, 100).writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.seq: (r.total_messages, r.late_messages) for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    assert got == {**{s: (i + 1, 0) for i, s in enumerate(early)}, **{s: (31 + i, 10) for i, s in enumerate(rest)}}


def test_checkpoint_partials_stream_equals_batch(spark):
    """Per-interval partials from the stream equal the batch partials of every closed window."""
    s = fx.series(spark, SF_SMALL).withColumn("ts", F.timestamp_micros(F.col("elapsed_us") + F.lit(fx.BASE_US)))
    base = tempfile.mkdtemp(prefix="tickflow-x6-")
    s.write.parquet(os.path.join(base, "src"))
    stream = spark.readStream.schema(s.schema).parquet(os.path.join(base, "src"))
    q = (live.checkpoint_partials(stream, 60, "0 seconds").writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(base, "out")).select("run_id", "series", F.col("window.start").alias("w"), "samples", "valid", "min", "max")
    max_ts = s.agg(F.max("ts")).first()[0]
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    exp = (s.groupBy("run_id", "series", F.window("ts", "60 seconds").alias("window"))
           .agg(F.count(F.lit(1)).alias("samples"), F.count(v).alias("valid"), F.min(v).alias("min"), F.max(v).alias("max"))
           .where(F.col("window.end") <= F.lit(max_ts))
           .select("run_id", "series", F.col("window.start").alias("w"), "samples", "valid", "min", "max"))
    assert got.count() == exp.count() > 0
    assert got.exceptAll(exp).count() == 0


def _tick_stream(spark, log, bounds, reset_s, n=100):
    """The log replayed in files cut at `bounds` (event time in s since the base), one a micro-batch."""
    from tickflow.streaming import ticks as st

    base = tempfile.mkdtemp(prefix="tickflow-ticks-")
    src = os.path.join(base, "src")
    at = (F.unix_micros("event_ts") - F.lit(fx.BASE_US)) / 1e6
    for lo, hi in zip([-1e18, *bounds], [*bounds, 1e18]):
        log.where((at >= lo) & (at < hi)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(st.LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = (st.tick_metrics_stream(stream, n, reset_s, "5 seconds").writeStream.format("parquet").option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")), sum(p.numInputRows > 0 for p in q.recentProgress)


def test_tick_metrics_stream_equals_batch(spark):
    """Ticks from timers over seven micro-batches equal the batch, for two reset lengths, frozen
    gauges of a topic that went quiet included; a topic without messages publishes nothing."""
    from pyspark.sql import Row

    from tickflow.operators import ticks
    from tickflow.streaming import ticks as st

    rnd = __import__("random").Random(5)
    rows, b = [], fx.BASE_US
    for topic, quiet in (("a", None), ("b", 20_000_000), ("late", 0)):
        t = b + (30_000_000 if topic == "late" else 0)
        for i in range(120):
            t += rnd.choice([20_000, 333_333, 700_001, 1_500_000])
            if quiet and t > b + quiet:
                break
            rows.append(Row(run_id="r", topic=topic, seq=i, arrival_us=t, width=10 + i, height=2, point_step=16, data_len=i % 5))
    rows.append(Row(run_id="r", topic="one", seq=0, arrival_us=b + 5_000_000, width=1, height=1, point_step=1, data_len=1))
    msgs = spark.createDataFrame(rows)
    runs = spark.createDataFrame([Row(run_id="r", topic=x, start_us=b, duration_s=60.25, tick_rate_hz=2.0) for x in ("a", "b", "late", "one", "never")])
    log = st.tick_log(msgs, runs).cache()
    for reset_s in (1.0, 7.0):
        want = ticks.tick_metrics(msgs, runs, n=8, reset_s=reset_s)
        got, batches = _tick_stream(spark, log, [7, 15, 26, 40, 52], reset_s, n=8)
        assert batches >= 6
        assert got.count() == want.count() > 200
        assert got.select(*want.columns).exceptAll(want).count() == 0
    assert got.where("topic = 'b' and tick > 60").select("current_hz").distinct().count() == 1


def test_checkpoints_roll_up_across_a_failed_batch(spark):
    """A batch that fails after its partials are written and runs again counts once; late
    samples count too. Equal to W15, whose offset of 1e9 would cancel in sums of squares."""
    from tickflow.operators import stats

    base = tempfile.mkdtemp(prefix="tickflow-x6-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    rows = [("r", s, i, 700_000 * i, float("nan") if i % 11 == 0 else 1e9 + (i * 37 % 101) / 7) for s in ("a", "b") for i in range(300)]
    series = spark.createDataFrame(rows, "run_id string, series string, idx long, elapsed_us long, value double")
    runs = spark.createDataFrame([("r", "a", 200.0), ("r", "b", 150.5), ("r", "c", 30.0)], "run_id string, series string, duration_s double")
    for part in (2, 0, 1):
        series.where(F.col("idx") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    write, failed = live.checkpoint_writer(out, 20.0, runs=runs), []

    def fails_once(batch, epoch_id):
        write(batch, epoch_id)
        if epoch_id == 1 and not failed:
            failed.append(epoch_id)
            raise RuntimeError("lost after the write")

    def start():
        stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(src)
        return stream.writeStream.foreachBatch(fails_once).option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start()

    try:
        start().awaitTermination()
    except Exception:  # the query's own failure
        assert failed == [1]
    start().awaitTermination()
    got = {(r.series, r.checkpoint): r for r in live.rolled_checkpoints(spark, out, runs, 20.0).collect()}
    want = {(r.series, r.checkpoint): r for r in stats.cumulative_checkpoints(series, runs, 20.0).collect()}
    assert failed == [1] and set(got) == set(want) and len(want) == 10 + 8 + 2
    for k, w in want.items():
        assert (got[k].samples, got[k].valid, got[k].min, got[k].max, got[k].end_us, got[k].last_elapsed_us) == (w.samples, w.valid, w.min, w.max, w.end_us, w.last_elapsed_us)
        assert abs(got[k].avg - w.avg) < 1e-6 and abs(got[k].std - w.std) < 1e-6
    values = [v for _, s, _, e, v in rows if s == "a" and e <= 200_000_000 and v == v]
    mean = sum(values) / len(values)
    assert abs(want["a", 10].std - (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5) < 1e-6


def _replay(spark, base, parts, start):
    """Each part written, then the stream run until it has read it: a micro-batch a part."""
    src = os.path.join(base, "src")
    for part in parts:
        part.coalesce(2).write.mode("append").parquet(src)
        start(src).awaitTermination()


def test_late_rows_are_kept_and_add_up(spark):
    """Rows in = rows counted + late rows, for X4 and X1, from files out of order and across a
    batch that fails half way and runs again; windows and reasons equal a model row by row."""
    from tickflow.streaming import late

    rnd = __import__("random").Random(11)
    base = tempfile.mkdtemp(prefix="tickflow-x8-")
    out, gauges = os.path.join(base, "out"), os.path.join(base, "gauges")
    rows = [("r", t, i, fx.BASE_US + i * 700_000 + rnd.randrange(900_000), 4, 2, 8, i % 3) for t in ("a", "b") for i in range(120)]
    rows += [("r", "c", i, None if i == 3 else fx.BASE_US + i, 1, 1, 1, 0) for i in range(5)]
    schema = "run_id string, topic string, seq long, arrival_us long, width long, height long, point_step long, data_len long"
    order = sorted(rows, key=lambda r: (r[3] or fx.BASE_US) + rnd.choice([0, 0, 0, 15_000_000, 40_000_000]))
    cuts = [order[i : i + 50] for i in range(0, len(order), 50)]
    write, failed = late.late_writer(out, 2, 5_000_000), []

    def fails_once(batch, epoch_id):
        if epoch_id == 2 and not failed:
            failed.append(epoch_id)
            batch.limit(3).selectExpr("run_id", "topic", "seq", "arrival_us", "0L watermark_us", "'x' reason").write.parquet(f"{out}/late/batch=2")
            raise RuntimeError("lost half way")
        write(batch, epoch_id)

    def side(src):
        stream = spark.readStream.schema(schema).parquet(src)

        def start():
            return stream.writeStream.foreachBatch(fails_once).option("checkpointLocation", os.path.join(base, "c1")).trigger(availableNow=True).start()

        q = start()
        try:
            q.awaitTermination()
        except Exception:  # the query's own failure
            assert failed == [2]
            q = start()
        return q

    def folded(src):
        stream = spark.readStream.schema(schema).parquet(src)
        return (live.live_gauges(stream.where("arrival_us IS NOT NULL"), 8).writeStream.format("parquet").option("path", gauges)
                .option("checkpointLocation", os.path.join(base, "c2")).trigger(availableNow=True).start())

    frames = [spark.createDataFrame(c, schema) for c in cuts]
    _replay(spark, base, frames, lambda src: (side(src).awaitTermination(), folded(src))[1])
    want, counts, known, last = [], {}, None, {}
    for b, cut in enumerate(cuts):
        mark = None if known is None else known - 5_000_000
        for _, t, seq, at, w, h, step, n in cut:
            start = None if at is None else at // 2_000_000 * 2_000_000
            closed = None not in (start, mark) and start + 2_000_000 <= mark
            want += [(t, seq, "window_closed", b)] * closed + [(t, seq, "out_of_order", b)] * (seq <= last.get(t, -1))
            if not closed:
                counts[t, start] = counts.get((t, start), 0) + 1
        known = max([r[3] for r in cut if r[3] is not None] + [known or 0])
        for r in cut:
            last[r[1]] = max(last.get(r[1], -1), r[2])
    got = late.late_rows(spark, out)
    assert failed == [2] and sorted((r.topic, r.seq, r.reason, r.batch) for r in got.collect()) == sorted(want)
    windows = late.window_counts(spark, out, 2, 5_000_000).collect()
    assert {(r.topic, r.window_start_us): r.messages for r in windows} == counts
    assert all(r.closed == (r.window_start_us is not None and r.window_start_us + 2_000_000 <= known - 5_000_000) for r in windows)
    by = {r.reason: r["count"] for r in got.groupBy("reason").count().collect()}
    assert by["window_closed"] > 5 and len(rows) == sum(counts.values()) + by["window_closed"]
    seen = got.where("reason = 'out_of_order' AND topic <> 'c'").count()
    assert spark.read.parquet(gauges).where("topic <> 'c'").count() + seen == 240


def test_silences_on_a_stream_equal_the_batch(spark):
    """Closed stretches equal the batch; a topic that never sends is told while the run goes on;
    messages in any order inside the watermark; rows after the end change nothing."""
    from tickflow.operators.align import silences
    from tickflow.streaming import silence
    from tickflow.streaming import ticks as st

    rnd, b = __import__("random").Random(3), fx.BASE_US
    at = {"a": sorted(rnd.randrange(60_000_000) for _ in range(25)), "quiet": [5_000_000, 5_000_000, 9_000_000], "over": [1_000_000, 70_000_000], "edge": [0, 60_000_000]}
    schema = "run_id string, topic string, seq long, arrival_us long, width long, height long, point_step long, data_len long"
    msgs = spark.createDataFrame([("r", t, i, b + us, 1, 1, 1, 1) for t, v in at.items() for i, us in enumerate(v)], schema)
    runs = spark.createDataFrame([("r", t, b, 60.0, 2.0) for t in (*at, "never")] + [("r", "brief", b, 1.5, 2.0)], "run_id string, topic string, start_us long, duration_s double, tick_rate_hz double")
    log = st.tick_log(msgs, runs).cache()
    base = tempfile.mkdtemp(prefix="tickflow-j7-")
    ts = (F.unix_micros("event_ts") - F.lit(b)) / 1e6

    def start(src):
        stream = spark.readStream.schema(st.LOG_SCHEMA).parquet(src)
        return (silence.silences_stream(stream, 4_000_000, "3 seconds").writeStream.format("parquet").option("path", os.path.join(base, "out"))
                .option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())

    cuts = [-1e18, 8, 20, 33, 50, 65, 1e18]
    _replay(spark, base, [log.where((ts >= lo) & (ts < hi)).orderBy(F.rand(1)) for lo, hi in zip(cuts, cuts[1:])], start)
    got = spark.read.parquet(os.path.join(base, "out"))
    want = silences(runs, msgs, 4_000_000)
    closed = got.where("until_us IS NOT NULL").select(*want.columns)
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, want.collect()))
    told = {(r.topic, r.from_us - b) for r in got.where("until_us IS NULL").collect()}
    assert ("never", 0) in told and ("quiet", 9_000_000) in told and not any(t == "brief" for t, _ in told)
    assert told - {(r.topic, r.from_us - b) for r in want.collect()} == set()  # none is told that the batch doesn't have


def test_a_gauge_fold_returns_pieces(spark):
    """A micro-batch larger than a piece: frames of at most that many rows, the same values as all at once."""
    import numpy as np
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    seq = np.random.default_rng(7).permutation(500)
    new = pd.DataFrame({"seq": seq, "arrival_us": seq * 1000 + seq % 7, "size": seq % 11, "points": seq % 5})
    cuts, whole = State(), State()
    frames = list(live._fold(("r", "t"), ("run_id", "topic"), iter([new[:200], new[200:]]), cuts, 8, 64))
    assert [len(f) for f in frames] == [64] * 7 + [52]
    once = list(live._fold(("r", "t"), ("run_id", "topic"), iter([new]), whole, 8, 1000))
    pd.testing.assert_frame_equal(pd.concat(frames, ignore_index=True), once[0])
    assert cuts.get == whole.get


def test_live_gauges_replayed_in_cuts(spark, monkeypatch):
    """The query's replay in several runs of the stream gives the rows of one, none of them late."""
    from tickflow.plans import io_queries

    whole = io_queries.q_live_gauges(spark, SF_SMALL)
    monkeypatch.setattr(io_queries, "LIVE_ROWS", 300)
    parts = io_queries._in_cuts(spark, fx.messages(spark, SF_SMALL), 300)
    sizes = [p.count() for p in parts]
    assert len(sizes) > 2 and max(sizes) < 600 and sum(sizes) == whole.count()
    monkeypatch.setattr(io_queries, "LIVE_ROWS", -(-whole.count() // 3))
    cut = io_queries.q_live_gauges(spark, SF_SMALL)
    assert cut.count() == whole.count() and cut.exceptAll(whole).count() == 0


def test_due_ticks_read_only_their_messages(spark):
    """A timer takes the packs of due ticks alone out of the state; messages of an earlier number than one
    of a later tick, duplicates and small pieces change no row."""
    import numpy as np
    import pandas as pd

    from tickflow.streaming import ticks as st

    class Held(dict):
        taken = 0

        def exists(self):
            return bool(self)

        def get(self):
            return dict.get(self, "v")

        def update(self, v):
            self["v"] = v

        def updateValue(self, k, v):
            assert k not in self
            self[k] = v

        def getValue(self, k):
            self.taken += k[2]
            return self[k]

        def removeKey(self, k):
            del self[k]

        def keys(self):
            return list(dict.keys(self))

    class Handle:
        def __init__(self):
            self.states = {}

        def getValueState(self, name, *schemas):
            return self.states.setdefault(name, Held())

        getMapState = getValueState

        def registerTimer(self, at):
            pass

    class Timer:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    rnd = np.random.default_rng(2)
    seq = np.arange(1000)
    at = fx.BASE_US + seq * 20_000 + np.where(seq % 13 == 0, 1_700_000, 0)  # some come with a later time than their number
    log = pd.DataFrame({"kind": st.MESSAGE, "seq": seq, "arrival_us": at, "size": seq % 9, "points": seq % 4, "start_us": fx.BASE_US, "duration_s": 30.0, "tick_rate_hz": 2.0})
    log = pd.concat([log, log[::50]]).iloc[rnd.permutation(1020)]
    results, taken = [], []
    for held_rows in (16, 1 << 19):
        p = st.TickProcessor(8, 5.0, held_rows)
        p.init(Handle())
        list(p.handleInputRows(("r", "t"), iter([log[:400], log[400:]]), None))
        out = []
        for s in (4, 9, 31):
            before = p.pending.taken
            out += list(p.handleExpiredTimer(("r", "t"), Timer(fx.BASE_US // 1000 + s * 1000), None))
            taken.append(p.pending.taken - before)
        results.append(pd.concat(out, ignore_index=True))
    pd.testing.assert_frame_equal(*results)
    assert max(taken[0], taken[3]) < 300 and len(results[0]) == 57 and results[0]["total_messages"].iloc[-1] == 1000
    # one timer for everything gives the same ticks
    p = st.TickProcessor(8, 5.0)
    p.init(Handle())
    list(p.handleInputRows(("r", "t"), iter([log]), None))
    once = pd.concat(list(p.handleExpiredTimer(("r", "t"), Timer(fx.BASE_US // 1000 + 31_000), None)), ignore_index=True)
    pd.testing.assert_frame_equal(once, results[0])
