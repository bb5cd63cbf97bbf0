"""Timer-tick sampling of the message gauges (J3), overall rates (W6) and the resettable
throughput counters (W7).

Tick i fires at ``start + i·step`` (step = 1/rate s). A message belongs to tick
``max(1, ceil((arrival − start)/step))`` (a message at the tick instant is seen by it). Nothing
is published before the first tick ``f`` with at least 2 messages; afterwards every tick
publishes, the last-N gauges freezing when the stream goes quiet.

Reset rule, closed form: with ``c = ceil(reset/step)`` and ``R0 = max(f, c)`` the last reset
before tick i is 0 when ``i <= R0``, else ``R0 + ((i−1−R0) div c)·c``.

Scale: the last message of each tick is found where the gauges are (no shuffle), dealt once by
(run, topic, block of BLOCK ticks), and stands for the *span* of ticks up to the next one. Ticks
are only made at the very end, a span at a time, so neither the grid nor any window holds a topic's
whole run. What crosses block edges goes through a table with one row a block:

* level one: the last gauges and the first published tick of each block, carried forward over
  the blocks of the run (which come from the run table, so silent blocks are there too);
* level two: the totals at the last reset inside each block, carried forward likewise. Inside a
  block the totals since the last reset are a scan that starts from the carried ones and anew at
  every span that holds a reset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickflow import schemas as S
from tickflow.operators.windows import STREAM_KEYS, message_gauges
from tickflow.schemas import RESET_SECONDS, WINDOW_SIZE

BLOCK = 1 << 16  # ticks of a topic that one task windows at once

GAUGE_COLS = [
    "current_hz",
    "jitter_ms",
    "min_interval_ms",
    "max_interval_ms",
    "avg_hz",
    "bandwidth_mbps",
    "avg_message_size_kb",
    "avg_points_per_message",
    "total_messages",
    "total_bytes",
    "total_points",
    "arrival_us",
]


def _step_us() -> F.Column:
    return F.lit(1e6) / F.col("tick_rate_hz")


def tick_blocks(runs: DataFrame, keys: Sequence[str] = STREAM_KEYS, block: int = BLOCK) -> DataFrame:
    """One row per block of ``block`` ticks of each (run, topic): ``tb``, its first and last tick."""
    ctx = runs.select(*keys, "start_us", "tick_rate_hz", F.floor(F.col("duration_s") * F.col("tick_rate_hz")).cast("long").alias("_nt"))
    tb = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_nt - 1) div {int(block)}"))).alias("tb")
    out = ctx.where(F.col("_nt") >= 1).select("*", tb)
    return out.select("*", (F.col("tb") * block + 1).alias("_lo"), F.least((F.col("tb") + 1) * block, F.col("_nt")).alias("_hi"))


def message_tick(arrival_us: str = "arrival_us") -> F.Column:
    """Tick that first sees a message."""
    rel = (F.col(arrival_us) - F.col("start_us")).cast("double") / _step_us()
    return F.greatest(F.lit(1).cast("long"), F.ceil(rel).cast("long"))


def tick_us() -> F.Column:
    return F.col("start_us") + F.round(F.col("tick").cast("double") * _step_us()).cast("long")


def last_of_ticks(gauges: DataFrame, runs: DataFrame, keys: Sequence[str], cols: Sequence[str], block: int) -> DataFrame:
    """The last message row of every tick: keys, ``tb``, ``tick``, ``idx``, ``_g`` (the gauges),
    dealt by (keys, tb). Where a key's index blocks meet, a tick may have two rows.

    When the gauges come from :func:`message_gauges` (``block`` column present) the row is found
    with ``lead`` inside the existing (key, block) partitions: no new shuffle or sort."""
    ctx = runs.select(*keys, "start_us", "tick_rate_hz", F.floor(F.col("duration_s") * F.col("tick_rate_hz")).cast("long").alias("_nt"))
    blocked = "block" in gauges.columns
    need = [*keys, "idx", *[c for c in cols if c not in keys and c != "idx"], *(["block"] if blocked else [])]
    g = gauges.select(*need).join(ctx, list(keys)).select(*need, message_tick().alias("tick"), "_nt")
    if blocked:
        g = g.select("*", F.lead("tick").over(Window.partitionBy(*keys, "block").orderBy("idx")).alias("_nxt"))
        g = g.where((F.col("tick") <= F.col("_nt")) & (F.col("_nxt").isNull() | (F.col("_nxt") != F.col("tick"))))
    else:
        g = g.where(F.col("tick") <= F.col("_nt"))
    rows = g.select(*keys, F.expr(f"(tick - 1) div {int(block)}").alias("tb"), "tick", "idx", F.struct(*[F.col(c) for c in cols]).alias("_g"))
    return rows.repartition(*keys, "tb")


def tick_spans(
    gauges: DataFrame, runs: DataFrame, keys: Sequence[str], cols: Sequence[str], block: int, reset_s: float | None = None
) -> DataFrame:
    """Spans of ticks with equal gauges, none over a block's edge: keys, ``start_us``,
    ``tick_rate_hz``, ``_s`` .. ``_e``, ``_g`` (NULL before the first message).

    With ``reset_s`` (``cols`` hold the three totals) also ``_f`` (the first published tick), ``_r0``,
    ``_c`` and ``_base``, the totals at the last reset before ``_s`` (NULL: no reset yet)."""
    part, order = [*keys, "tb"], F.struct("tick", "idx")
    rows = last_of_ticks(gauges, runs, keys, cols, block)
    # every use of `rows` reads all of its columns, so that Spark deals them once
    published = F.min(F.when(F.col("_g.total_messages") >= 2, F.col("tick"))) if reset_s is not None else F.lit(None).cast("long")
    ends = rows.groupBy(*part).agg(F.max_by(F.struct("tick", "idx", "_g"), order).alias("_last"), F.min("tick").alias("_first"), published.alias("_p"))
    over = Window.partitionBy(*keys)
    prior = over.orderBy("tb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = tick_blocks(runs, keys, block).join(ends, part, "left")
    blocks = blocks.select(*part, "start_us", "tick_rate_hz", "_lo", "_hi", "_first", F.last("_last._g", ignorenulls=True).over(prior).alias("_in"), F.min("_p").over(over).alias("_f"))
    extra = []
    if reset_s is not None:
        blocks = blocks.select("*", F.ceil(F.lit(reset_s * 1e6) / _step_us()).cast("long").alias("_c"))
        blocks = blocks.select("*", F.greatest("_f", "_c").alias("_r0"))
        # the last reset tick of the block, and the totals at it
        blocks = blocks.select("*", F.expr("CASE WHEN _f IS NOT NULL AND _hi >= _r0 AND _r0 + ((_hi - _r0) div _c) * _c >= _lo THEN _r0 + ((_hi - _r0) div _c) * _c END").alias("_q"))
        reset = rows.join(blocks.select(*part, "_q", F.col("_in").alias("_in0")), part).groupBy(*part, "_q")
        # as a filter on the aggregate (and with `_in`): otherwise `rows` would get another plan here
        at_reset = reset.agg(F.expr("max_by(struct(tick, idx, _g), struct(tick, idx)) FILTER (WHERE tick <= _q)").alias("_at"), F.first("_in0").alias("_in0"))
        blocks = blocks.join(at_reset.select(*part, F.coalesce("_at._g", "_in0").alias("_at")), part, "left")
        blocks = blocks.select("*", F.when(F.col("_q").isNotNull(), F.coalesce("_at", "_in")).alias("_bq"))
        blocks = blocks.select(*[c for c in blocks.columns if c not in ("_q", "_at", "_bq")], F.last("_bq", ignorenulls=True).over(prior).alias("_bin"))
        extra = ["_f", "_r0", "_c", "_bin"]
    inside = Window.partitionBy(*part).orderBy("tick", "idx")
    spans = rows.join(blocks.select(*part, "start_us", "tick_rate_hz", "_hi", *extra), part)
    spans = spans.select("*", F.lead("tick").over(inside).alias("_nxt")).where(F.col("_nxt").isNull() | (F.col("_nxt") != F.col("tick")))
    held = [*part, "start_us", "tick_rate_hz", *extra]
    spans = spans.select(*held, F.col("tick").alias("_s"), F.coalesce(F.col("_nxt") - 1, F.col("_hi")).alias("_e"), "_g")
    quiet = blocks.select(*held, F.col("_lo").alias("_s"), F.coalesce(F.col("_first") - 1, F.col("_hi")).alias("_e"), F.col("_in").alias("_g"))
    # dealt anew: the block table stands by key, and a silent topic's ticks belong to many tasks
    spans = spans.unionByName(quiet.where(F.col("_e") >= F.col("_s"))).repartition(*part)
    if reset_s is None:
        return spans
    # a scan inside the block: the totals at the last span before that holds a reset, else the carried ones
    holds = F.expr("CASE WHEN _e >= _r0 AND _r0 + ((_e - _r0) div _c) * _c >= _s THEN _g END")
    before = Window.partitionBy(*part).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return spans.select("*", F.coalesce(F.last(holds, ignorenulls=True).over(before), F.col("_bin")).alias("_base"))


def sample_at_ticks(
    gauges: DataFrame,
    runs: DataFrame,
    keys: Sequence[str] = STREAM_KEYS,
    cols: Sequence[str] = GAUGE_COLS,
    *,
    block: int = BLOCK,
) -> DataFrame:
    """Gauge values at every tick = the last message row with arrival <= tick.
    Ticks before the first message carry NULL gauges."""
    t = tick_spans(gauges, runs, keys, cols, block).select("*", F.explode(F.sequence("_s", "_e")).alias("tick"))
    return t.select(*keys, "tick", tick_us().alias("tick_us"), "start_us", "tick_rate_hz", *[F.col("_g").getField(c).alias(c) for c in cols])


def tick_metrics(
    msgs: DataFrame,
    runs: DataFrame,
    n: int = WINDOW_SIZE,
    reset_s: float = RESET_SECONDS,
    keys: Sequence[str] = STREAM_KEYS,
    *,
    block: int = BLOCK,
    **kw,
) -> DataFrame:
    """All 17 stream metrics at every published tick, plus the diagnostic level/message.

    Combines W1-W5 (per message), J3 (tick sampling), W6 (overall rates since the run start)
    and W7 (resettable throughput)."""
    gauges = message_gauges(msgs, n, keys, **kw)
    if "min_interval_ms" not in gauges.columns:  # with_min_max=False: the summaries skip them
        gauges = gauges.select("*", F.lit(None).cast("double").alias("min_interval_ms"), F.lit(None).cast("double").alias("max_interval_ms"))
    spans = tick_spans(gauges, runs, keys, GAUGE_COLS, block, reset_s)
    spans = spans.where(F.col("_e") >= F.col("_f")).withColumn("_s0", F.greatest("_s", "_f"))
    t = spans.select("*", F.explode(F.sequence("_s0", "_e")).alias("tick"))
    # counters since the last reset = totals now minus at the reset tick: the span's own if it holds
    # the reset, else those before it (none before the first reset)
    lr = "CASE WHEN tick <= _r0 THEN CAST(0 AS BIGINT) ELSE _r0 + ((tick - 1 - _r0) div _c) * _c END"
    t = t.select("*", F.expr(lr).alias("_lr"))
    since = "(_g.{0} - CASE WHEN _lr = 0 THEN 0 WHEN _lr >= _s THEN _g.{0} ELSE _base.{0} END)"
    t = t.select(
        *keys, "tick", tick_us().alias("tick_us"), "tick_rate_hz", "_lr", *[F.col("_g").getField(c).alias(c) for c in GAUGE_COLS],
        *[F.expr(since.format(src)).alias(dst) for src, dst in (("total_messages", "_tm"), ("total_bytes", "_tb"), ("total_points", "_tp"))],
    )
    return tick_formulas(t, keys)


def tick_formulas(t: DataFrame, keys: Sequence[str] = STREAM_KEYS) -> DataFrame:
    """The published metrics of a tick from its gauges, its totals since the last reset (``_tm``,
    ``_tb``, ``_tp``) and the tick of that reset (``_lr``); the same in batch and stream."""
    # per-tick formulas as SQL expressions (one JVM call each); the level rule is F5
    step_sql = "(1000000D / tick_rate_hz)"
    window_s = f"(CAST(tick - _lr AS DOUBLE) * {step_sql} / 1000000D)"
    elapsed_s = f"(CAST(tick AS DOUBLE) * {step_sql} / 1000000D)"
    pps = f"(CAST(_tp AS DOUBLE) / {window_s})"
    low, jit = "coalesce(current_hz, 0D) < 5", "coalesce(jitter_ms, 0D) > 50"
    exprs = {
        "overall_avg_hz": f"CAST(total_messages AS DOUBLE) / {elapsed_s}",
        "overall_bandwidth_mbps": f"CAST(total_bytes AS DOUBLE) / {elapsed_s} * 8D / 1000000D",
        "total_messages": "total_messages",
        "total_mb": "CAST(total_bytes AS DOUBLE) / 1000000D",
        "avg_message_size_kb": "avg_message_size_kb",
        "messages_per_second": f"CAST(_tm AS DOUBLE) / {window_s}",
        "mbytes_per_second": f"CAST(_tb AS DOUBLE) / {window_s} / 1000000D",
        "points_per_second": pps,
        "kpoints_per_second": f"{pps} / 1000D",
        "avg_points_per_message": "avg_points_per_message",
        "total_points_millions": "CAST(total_points AS DOUBLE) / 1000000D",
        "level": f"CASE WHEN {low} THEN {S.LEVEL_WARN} WHEN {jit} THEN {S.LEVEL_WARN} ELSE {S.LEVEL_OK} END",
        "message": f"CASE WHEN {low} THEN '{S.MSG_LOW_FREQUENCY}' WHEN {jit} THEN '{S.MSG_HIGH_JITTER}' ELSE '{S.MSG_OPERATING_NORMALLY}' END",
        "last_arrival_us": "arrival_us",
    }
    return t.select(
        *keys,
        "tick",
        "tick_us",
        "current_hz",
        "jitter_ms",
        "min_interval_ms",
        "max_interval_ms",
        "avg_hz",
        "bandwidth_mbps",
        *[F.expr(e).alias(name) for name, e in exprs.items()],
    )


def overall_rate(ticks: DataFrame) -> DataFrame:
    """W6 view of :func:`tick_metrics`."""
    return ticks.select(*STREAM_KEYS, "tick", "total_messages", "overall_avg_hz", "overall_bandwidth_mbps")


def resettable_throughput(ticks: DataFrame) -> DataFrame:
    """W7 view of :func:`tick_metrics`."""
    return ticks.select(
        *STREAM_KEYS, "tick", "messages_per_second", "mbytes_per_second", "points_per_second", "kpoints_per_second"
    )


def staleness(ticks: DataFrame) -> DataFrame:
    """seconds between each tick and the last message seen by it."""
    return ticks.select(
        *STREAM_KEYS,
        "tick",
        ((F.col("tick_us") - F.col("last_arrival_us")).cast("double") / F.lit(1e6)).alias("stale_s"),
    )


def sample_staleness(ticks: DataFrame, samples: DataFrame, by: Sequence[str] = STREAM_KEYS, sample_time: str = "sample_us") -> DataFrame:
    """F15, the host's side: seconds between each tick and the last system sample at or before it
    (null before the first). ``samples`` carry the columns ``by`` of the ticks they are shown with."""
    from tickflow.operators.align import align_asof

    seen = align_asof(ticks.select(*by, "tick", "tick_us"), samples.select(*by, sample_time), by, "tick_us", sample_time, [sample_time])
    return seen.select(*by, "tick", ((F.col("tick_us") - F.col("r_time")).cast("double") / F.lit(1e6)).alias("stale_s"))
