"""Windows over ordered messages and samples.

The message gauges are evaluated per (run, topic, block) over a dense arrival index with a
halo of ``n`` rows (see :mod:`tickflow.operators.scale`), so a hot topic is spread over
many tasks. Sums over the last-N frame are differences of running sums (O(rows), exact in
integers: µs, bytes, points); the interval moments use decimal(38,0) so the variance
``(n·Σx² − (Σx)²)/n²`` is exact before the single square root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickflow.functions.scalars import message_size, point_count
from tickflow.operators.scale import (
    DEFAULT_BLOCK_ROWS,
    DEFAULT_BUCKET_WIDTH,
    dense_index,
    halo_blocks,
    sliding_min_max,
)
from tickflow.schemas import RETENTION_POINTS, ROLLING_SAMPLES, TOP_SLOTS, WINDOW_SIZE

STREAM_KEYS = ("run_id", "topic")
DEC = "decimal(38,0)"
INF = float("inf")


def _round_up(x: int, m: int) -> int:
    return ((x + m - 1) // m) * m


def indexed_messages(
    msgs: DataFrame,
    keys: Sequence[str] = STREAM_KEYS,
    *,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
) -> DataFrame:
    """P1/P2 plus the dense arrival index: ``idx``, ``cum_size``, ``cum_points`` (inclusive)."""
    m = msgs.select(
        *keys,
        "seq",
        "arrival_us",
        message_size().alias("size"),
        point_count().alias("points"),
    )
    return dense_index(m, keys, "seq", bucket_width=bucket_width, cumulative=["size", "points"])


def inter_arrival(msgs: DataFrame, keys: Sequence[str] = STREAM_KEYS, **kw) -> DataFrame:
    """``interval_us = t − previous t`` (NULL for the first message of a topic)."""
    g = message_gauges(msgs, 1, keys, with_min_max=False, **kw)
    return g.select(*keys, "seq", "idx", "arrival_us", "interval_us")


def message_gauges(
    msgs: DataFrame,
    n: int = WINDOW_SIZE,
    keys: Sequence[str] = STREAM_KEYS,
    *,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
    with_min_max: bool = True,
) -> DataFrame:
    """W1-W5 on every message row (the collector state right after that message).

    Columns: interval_us (W1); n_intervals, current_hz, jitter_ms, min/max_interval_ms (W2);
    n_stamps, avg_hz, bandwidth_mbps (W3); avg_message_size_kb, avg_points_per_message (W4);
    total_messages, total_bytes, total_mb, total_points, total_points_millions (W5); ``block``
    is the index block the row was evaluated in (rows come out hash-partitioned by
    (keys, block) and sorted by idx inside it, which :func:`ticks.sample_at_ticks` reuses).
    """
    if n < 1:
        raise ValueError("window size must be >= 1")
    block_rows = _round_up(max(block_rows, n), n)
    m = indexed_messages(msgs, keys, bucket_width=bucket_width)
    b = halo_blocks(m, "idx", block_rows=block_rows, halo=n).select("*", F.expr(f"idx div {int(n)}").alias("_chk"))
    part = [*keys, "_blk"]
    # ordered by (chunk, idx) — the same order as idx — so the sliding min/max windows below
    # reuse this sort
    w = Window.partitionBy(*part).orderBy("_chk", "idx")
    run = w.rowsBetween(Window.unboundedPreceding, 0)

    t = F.col("arrival_us")
    idx = F.col("idx")
    # few DataFrame calls: every call re-analyses the (large) plan
    b = b.select("*", (t - F.lag(t, 1).over(w)).alias("interval_us"))
    x = F.col("interval_us").cast(DEC)
    b = b.select(
        "*",
        F.sum(x * x).over(run).alias("_cs2"),
        F.first(t).over(run).alias("_t0"),
        F.lag(t, n).over(w).alias("_tn"),
        (F.lag(t, n - 1).over(w) if n > 1 else t).alias("_tn1"),
        F.lag("cum_size", n).over(w).alias("_csz"),
        F.lag("cum_points", n).over(w).alias("_cpt"),
    )
    b = b.select("*", F.lag("_cs2", n).over(w).alias("_cs2n"))
    if with_min_max:
        b = sliding_min_max(b, part, "idx", "interval_us", n, min_col="_imin", max_col="_imax")
    b = b.where(~F.col("_halo"))

    # The per-row formulas as SQL expressions (one JVM call each instead of one per operator).
    # W2 over the last n intervals (row i carries the interval ending at i); W3 over the last n
    # timestamps; frame sums are differences of running sums.
    n_int = f"CAST(least(idx, {n}) AS BIGINT)"
    span_int = f"(CASE WHEN idx >= {n} THEN arrival_us - _tn ELSE arrival_us - _t0 END)"
    zero = f"CAST(0 AS {DEC})"
    sumsq = f"(coalesce(_cs2, {zero}) - coalesce(_cs2n, {zero}))"
    var_us2 = (
        f"(CAST(CAST({n_int} AS {DEC}) * {sumsq} - CAST({span_int} AS {DEC}) * CAST({span_int} AS {DEC}) AS DOUBLE)"
        f" / CAST({n_int} * {n_int} AS DOUBLE))"
    )
    n_ts = f"CAST(least(idx + 1, {n}) AS BIGINT)"
    span_ts = f"(CASE WHEN idx >= {n - 1} THEN arrival_us - _tn1 ELSE arrival_us - _t0 END)"
    size_w = "(cum_size - coalesce(_csz, 0))"
    points_w = "(cum_points - coalesce(_cpt, 0))"
    exprs = {
        "n_intervals": n_int,
        "current_hz": f"CASE WHEN {n_int} > 0 THEN CASE WHEN {span_int} = 0 THEN double('inf') "
        f"ELSE CAST({n_int} AS DOUBLE) * 1000000D / CAST({span_int} AS DOUBLE) END END",
        "jitter_ms": f"CASE WHEN {n_int} > 0 THEN sqrt({var_us2}) / 1000D END",
    }
    if with_min_max:
        exprs["min_interval_ms"] = "CAST(_imin AS DOUBLE) / 1000D"
        exprs["max_interval_ms"] = "CAST(_imax AS DOUBLE) / 1000D"
    exprs.update(
        {
            "n_stamps": n_ts,
            "avg_hz": f"CASE WHEN {span_ts} > 0 THEN CAST({n_ts} AS DOUBLE) * 1000000D / CAST({span_ts} AS DOUBLE) END",
            "bandwidth_mbps": f"CASE WHEN {span_ts} > 0 THEN CAST({size_w} AS DOUBLE) * 8D / CAST({span_ts} AS DOUBLE) END",
            "avg_message_size_kb": f"CAST({size_w} AS DOUBLE) / CAST({n_ts} AS DOUBLE) / 1024D",
            "avg_points_per_message": f"CAST({points_w} AS DOUBLE) / CAST({n_ts} AS DOUBLE)",
            "total_messages": "idx + 1",
            "total_bytes": "cum_size",
            "total_mb": "CAST(cum_size AS DOUBLE) / 1000000D",
            "total_points": "cum_points",
            "total_points_millions": "CAST(cum_points AS DOUBLE) / 1000000D",
            "block": "_blk",
        }
    )
    out = b.select(
        *keys, "seq", "idx", "arrival_us", "size", "points", "interval_us", *[F.expr(e).alias(name) for name, e in exprs.items()]
    )
    return out


def last_n_interval_stats(msgs: DataFrame, n: int = WINDOW_SIZE, **kw) -> DataFrame:
    """current_hz, jitter_ms, min/max_interval_ms over the last n intervals."""
    g = message_gauges(msgs, n, **kw)
    return g.select(*STREAM_KEYS, "seq", "n_intervals", "current_hz", "jitter_ms", "min_interval_ms", "max_interval_ms")


def last_n_rate_bandwidth(msgs: DataFrame, n: int = WINDOW_SIZE, **kw) -> DataFrame:
    """avg_hz and bandwidth_mbps over the last n timestamps (only when their span > 0)."""
    g = message_gauges(msgs, n, with_min_max=False, **kw)
    return g.select(*STREAM_KEYS, "seq", "n_stamps", "avg_hz", "bandwidth_mbps")


def last_n_message_shape(msgs: DataFrame, n: int = WINDOW_SIZE, **kw) -> DataFrame:
    """Mean message size (KiB) and points per message over the last n messages."""
    g = message_gauges(msgs, n, with_min_max=False, **kw)
    return g.select(*STREAM_KEYS, "seq", "avg_message_size_kb", "avg_points_per_message")


def running_totals(msgs: DataFrame, keys: Sequence[str] = STREAM_KEYS, **kw) -> DataFrame:
    """Messages, MB (1e6) and million points since the run start, per message."""
    m = indexed_messages(msgs, keys, **kw)
    return m.select(
        *keys,
        "seq",
        (F.col("idx") + 1).alias("total_messages"),
        (F.col("cum_size").cast("double") / F.lit(1e6)).alias("total_mb"),
        (F.col("cum_points").cast("double") / F.lit(1e6)).alias("total_points_millions"),
    )


def progress_every_k(msgs: DataFrame, runs: DataFrame, k: int = 10, keys: Sequence[str] = STREAM_KEYS, **kw) -> DataFrame:
    """At every k-th message, messages so far divided by seconds since the run start."""
    m = indexed_messages(msgs, keys, **kw).where((F.col("idx") + 1) % k == 0)
    j = m.join(runs.select(*keys, "start_us"), list(keys))
    elapsed = (F.col("arrival_us") - F.col("start_us")).cast("double") / F.lit(1e6)
    return j.select(
        *keys,
        "seq",
        (F.col("idx") + 1).alias("received"),
        F.when(elapsed > 0, (F.col("idx") + 1).cast("double") / elapsed).alias("rate_hz"),
    )


# ---------------------------------------------------------------------------------------
# Sample windows
# ---------------------------------------------------------------------------------------
def rolling_mean_samples(
    samples: DataFrame,
    cols: Sequence[str] = ("cpu_percent", "memory_percent"),
    n: int = ROLLING_SAMPLES,
    keys: Sequence[str] = ("run_id", "host"),
    order_col: str = "sample_seq",
    *,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
) -> DataFrame:
    """Mean of each column over the last n samples (missing values count as 0.0).

    Evaluated as differences of running sums per (key, block) with an n-row halo."""
    block_rows = max(block_rows, n)
    base = samples.select(*keys, order_col, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v_{c}") for c in cols])
    m = dense_index(base, keys, order_col, bucket_width=bucket_width, idx_col="_idx")
    b = halo_blocks(m, "_idx", block_rows=block_rows, halo=n)
    w = Window.partitionBy(*keys, "_blk").orderBy("_idx")
    frame = w.rowsBetween(-(n - 1), 0)
    cnt = F.least(F.col("_idx") + 1, F.lit(n)).cast("double")
    out = b
    for c in cols:
        # sliding sum of doubles; n is small (60) and the frame stays inside the block
        out = out.withColumn(f"{c}_avg", F.sum(f"_v_{c}").over(frame) / cnt)
    return out.where(~F.col("_halo")).select(*keys, order_col, *[f"{c}_avg" for c in cols])


def keep_last_n(series: DataFrame, n: int = RETENTION_POINTS, keys: Sequence[str] = ("run_id", "series"),
                order_col: str = "idx") -> DataFrame:
    """Keep the newest n points of each series (n <= 0 keeps everything).

    The count per key comes from a grouped aggregate; rows are kept by position, so nothing
    is sorted as a whole. ``order_col`` must be a dense 0-based index."""
    if n <= 0:
        return series
    counts = series.groupBy(*keys).agg(F.max(order_col).alias("_last"))
    return series.join(counts, list(keys)).where(F.col(order_col) > F.col("_last") - n).drop("_last")


def top_n_per_sample(procs: DataFrame, n: int = TOP_SLOTS, keys: Sequence[str] = ("run_id", "host", "sample_seq"),
                     value_col: str = "rss_bytes") -> DataFrame:
    """The n largest processes by RSS per sample (ties → lower pid), rank 1..n.

    One sample holds a bounded number of processes; Catalyst inserts a WindowGroupLimit
    before the shuffle so only n rows per sample and map task move."""
    w = Window.partitionBy(*keys).orderBy(F.col(value_col).desc(), F.col("pid").asc())
    return procs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def first_seen_zero(top: DataFrame, value_col: str = "cpu_percent", keys: Sequence[str] = ("run_id", "host"),
                    sample_col: str = "sample_seq") -> DataFrame:
    """A process's CPU reads 0.0 the first time it enters the top-N and after every
    absence (the per-process cache only keeps current top-N members). Run after W10.

    "Was it in the previous sample's top-N?" is an equi-join of the ranked rows with themselves
    shifted by one sample on (run, host, pid, sample): no ordering per process, so a process
    present in every sample of a long run is not one task."""
    prev = top.select(*keys, "pid", (F.col(sample_col) + 1).alias(sample_col), F.lit(True).alias("_seen"))
    j = top.join(prev, [*keys, "pid", sample_col], "left")
    return j.withColumn(f"{value_col}_reported", F.when(F.col("_seen"), F.col(value_col)).otherwise(F.lit(0.0))).drop("_seen")


def live_window(series: DataFrame, window_seconds: int = 60, keys: Sequence[str] = ("run_id", "series"),
                rate_hz: int = 10, block_rows: int = 1 << 16) -> DataFrame:
    """Dashboard view. Mean of the last ``window_seconds·rate_hz`` points per series,
    shown only for points with elapsed >= max(0, last elapsed − window_seconds). ``idx`` is dense;
    frames are evaluated in blocks of it, each with the points before it that its frames reach."""
    n = window_seconds * rate_hz
    last = series.groupBy(*keys).agg(F.max("elapsed_us").alias("_last_us"))
    lo = F.greatest(F.lit(0), F.col("_last_us") - F.lit(window_seconds * 1000000))
    # only the rows shown and the n-1 rows before them are needed for the frame
    frame = Window.partitionBy(*keys, "_blk").orderBy("idx").rowsBetween(-(n - 1), 0)
    j = series.join(last, list(keys))
    first_shown = j.where(F.col("elapsed_us") >= lo).groupBy(*keys).agg(F.min("idx").alias("_first_idx"))
    # rows that can reach a shown row's frame: a bounded tail of each series
    tail = j.join(first_shown, list(keys)).where(F.col("idx") > F.col("_first_idx") - n)
    v = F.when(~F.isnan(F.col("value").cast("double")), F.col("value"))
    # sum/count rather than avg: integral series keep an exact sum
    out = halo_blocks(tail, "idx", block_rows=max(block_rows, n), halo=n - 1).withColumn("mean_value", F.sum(v).over(frame).cast("double") / F.count(v).over(frame).cast("double"))
    return out.where((F.col("elapsed_us") >= lo) & ~F.col("_halo")).select(*keys, "idx", "elapsed_us", "value", "mean_value")


def minmax_downsample(series: DataFrame, max_points: int = 8000, keys: Sequence[str] = ("run_id", "series")) -> DataFrame:
    """Series longer than ``max_points`` are cut by index into ``max_points // 2``
    near-equal bins (larger bins first, as an even array split) and only each bin's min and
    max point (first occurrence) is kept; shorter series are kept whole. A NaN wins only a bin
    that has nothing else, with its first point. Not sorted: order by ``idx`` to draw.

    Bins come from the dense index and the per-series length alone (a short series has a bin
    for each point): one grouped aggregate on (series, bin) that carries the two points."""
    lengths = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    bins = max_points // 2
    j = series.join(lengths, list(keys))
    size = f"greatest(_len div {bins}, 1L)"
    big = f"(_len div {bins} + 1) * (_len % {bins})"  # rows in the first bins, of one row more
    bin_id = F.expr(
        f"CASE WHEN _len <= {max_points} THEN idx WHEN idx < {big} THEN idx div (_len div {bins} + 1) ELSE _len % {bins} + (idx - {big}) div {size} END"
    )
    v, nan = F.col("value"), F.isnan("value")
    point = F.struct("idx", "elapsed_us", "value")
    picked = j.groupBy(*keys, bin_id.alias("_bin")).agg(
        F.min(F.struct(nan.alias("nan"), v.alias("v"), F.col("idx").alias("at"), point.alias("p")))["p"].alias("_lo"),
        F.max(F.struct((~nan).alias("real"), v.alias("v"), (-F.col("idx")).alias("at"), point.alias("p")))["p"].alias("_hi"),
    )
    points = F.when(F.col("_lo.idx") == F.col("_hi.idx"), F.array("_lo")).otherwise(F.array("_lo", "_hi"))
    return picked.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.idx", "_p.elapsed_us", "_p.value")
