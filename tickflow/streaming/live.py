"""Structured Streaming counterparts of the live metrics (X1, X4-X8; X2 and X3 are in
:mod:`tickflow.streaming.ticks`).

* X1 :func:`live_gauges` — last-N-row gauges per topic. Row frames are refused on streams,
  so the collector state (last N+1 arrivals, sizes, points and the running totals) is kept per
  (run, topic) with ``applyInPandasWithState``; each micro-batch is folded in seq order, pieces of
  FOLD_ROWS rows at once in 64-bit integers, of which a task holds four a row. Rows at or before the
  last seen seq are late: they join no gauge, and ``late_messages`` counts them.
* X4 :func:`tumbling_rates` — built-in windowed counts with a watermark (append mode).
* X5 :func:`snapshot_writer` — ``foreachBatch`` that publishes the full current table as a new version.
* X6 :func:`checkpoint_writer` — ``foreachBatch`` that keeps mergeable partials per micro-batch;
  :func:`rolled_checkpoints` gives the cumulative checkpoints so far. :func:`checkpoint_partials`
  has plain sums of closed intervals.
* X7 :func:`latest_labels` — latest slot labels, update mode.
* X8 — watermark on ``arrival_ts``; dropped rows show up as ``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickflow.functions.scalars import message_size, point_count
from tickflow.schemas import WINDOW_SIZE
from tickflow.streaming.ticks import gauges_at

GAUGE_COLS = (
    "seq long, idx long, arrival_us long, current_hz double, jitter_ms double, min_interval_ms double, max_interval_ms double, "
    "avg_hz double, bandwidth_mbps double, avg_message_size_kb double, avg_points_per_message double, "
    "total_messages long, total_mb double, total_points_millions double, late_messages long"
)
STATE_SCHEMA = "late long, last_seq long, total long, total_bytes long, total_points long, tail_t array<long>, tail_s array<long>, tail_p array<long>"


FOLDED = ("seq", "arrival_us", "size", "points")
FOLD_ROWS = 1 << 17  # rows whose gauges are computed and returned at once


def _fold(key, keys: Sequence[str], pdfs: Iterator[pd.DataFrame], state: GroupState, n: int, fold_rows: int = FOLD_ROWS) -> Iterator[pd.DataFrame]:
    late, last_seq, total, tb, tp, *tails = state.get if state.exists else (0, -(2**62), 0, 0, 0, [], [], [])
    parts: list[list[np.ndarray]] = [[] for _ in FOLDED]
    for pdf in pdfs:
        late += int((pdf["seq"] <= last_seq).sum())
        new = pdf[pdf["seq"] > last_seq]
        for part, c in zip(parts, FOLDED):
            part.append(new[c].to_numpy(np.int64))
    seq = np.concatenate(parts[0])
    order = np.argsort(seq, kind="stable")
    rows = [seq[order]]
    del seq
    for part in parts[1:]:  # one column after the other, so that only one is held twice
        rows.append(np.concatenate(part)[order])
        part.clear()
    parts.clear()
    out_cols = [*keys, *[c.split()[0] for c in GAUGE_COLS.split(", ")]]
    for lo in range(0, len(order), fold_rows):
        seq, *new = (x[lo : lo + fold_rows] for x in rows)
        k, old = len(seq), len(tails[0])
        t, s, p = (np.concatenate([np.array(tail, np.int64), x]) for tail, x in zip(tails, new))
        idx = total + np.arange(k)
        g = gauges_at(old + np.arange(k), idx, t, s, p, n)
        nbytes, points = tb + np.cumsum(s[old:]), tp + np.cumsum(p[old:])
        cols = dict(zip(keys, key)) | {"seq": seq, "idx": idx} | g
        cols |= {"total_messages": idx + 1, "total_mb": nbytes / 1e6, "total_points_millions": points / 1e6, "late_messages": late}
        tails = [x[-(n + 1) :] for x in (t, s, p)]
        last_seq, total, tb, tp = int(seq[-1]), total + k, int(nbytes[-1]), int(points[-1])
        yield pd.DataFrame(cols)[out_cols]
    state.update((late, last_seq, total, tb, tp, *[[int(x) for x in tail] for tail in tails]))


def live_gauges(stream: DataFrame, n: int = WINDOW_SIZE, keys: Sequence[str] = ("run_id", "topic")) -> DataFrame:
    """Per-message last-N gauges on a message stream (same values as the batch
    :func:`tickflow.operators.windows.message_gauges`)."""
    from tickflow.session import ship_package

    ship_package(stream.sparkSession)
    src = stream.select(*keys, "seq", "arrival_us", message_size().alias("size"), point_count().alias("points"))
    schema = "".join(f"`{k}` {src.schema[k].dataType.simpleString()}, " for k in keys) + GAUGE_COLS

    def fn(key, pdfs, state):
        return _fold(key, keys, pdfs, state, n)

    return src.groupBy(*keys).applyInPandasWithState(fn, schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def tumbling_rates(stream: DataFrame, seconds: int = 1, watermark: str = "10 seconds", keys: Sequence[str] = ("run_id", "topic")) -> DataFrame:
    """Messages, bytes and points per fixed window per topic, emitted once the watermark
    passes the window end (late rows are dropped and counted by the engine)."""
    return (
        stream.withWatermark("arrival_ts", watermark)
        .groupBy(*keys, F.window("arrival_ts", f"{seconds} seconds").alias("window"))
        .agg(F.count(F.lit(1)).alias("messages"), F.sum(message_size()).alias("bytes"), F.sum(point_count()).alias("points"))
    )


def open_windows(messages: DataFrame, closed: DataFrame, seconds: int = 1, keys: Sequence[str] = ("run_id", "topic")) -> DataFrame:
    """The windows that a bounded replay of ``messages`` has left open: those that
    :func:`tumbling_rates` hasn't emitted when its source ended (a batch over the same rows)."""
    whole = (
        messages.groupBy(*keys, F.window("arrival_ts", f"{seconds} seconds").alias("window"))
        .agg(F.count(F.lit(1)).alias("messages"), F.sum(message_size()).alias("bytes"), F.sum(point_count()).alias("points"))
    )
    return whole.join(closed.select(*keys, "window"), [*keys, "window"], "left_anti")


def checkpoint_partials(stream: DataFrame, interval_s: int, watermark: str, keys: Sequence[str] = ("run_id", "series")) -> DataFrame:
    """Per-interval partials (n, Σ, Σ², min, max) of a series stream in append mode."""
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(*keys, F.window("ts", f"{interval_s} seconds").alias("window"))
        .agg(F.count(F.lit(1)).alias("samples"), F.count(v).alias("valid"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"),
             F.min(v).alias("min"), F.max(v).alias("max"))
    )


def checkpoint_writer(path: str, interval_s: float, keys: Sequence[str] = ("run_id", "series"), runs: DataFrame | None = None):
    """``foreachBatch`` callback that keeps the partials of each micro-batch of a series stream in
    a folder named by the batch. A batch that runs again after a failure replaces its folder, so no
    sample counts twice; late samples join the interval they belong to."""
    from tickflow.operators.stats import checkpoint_partials as partials

    def write(batch: DataFrame, epoch_id: int) -> None:
        partials(batch, interval_s, keys, runs, keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch_id}")

    return write


def rolled_checkpoints(spark: SparkSession, path: str, runs: DataFrame, interval_s: float, keys: Sequence[str] = ("run_id", "series")) -> DataFrame:
    """The cumulative checkpoints (W15) of what :func:`checkpoint_writer` has kept so far."""
    from tickflow.operators.stats import PARTIALS, merged_checkpoints

    schema = "".join(f"`{k}` {runs.schema[k].dataType.simpleString()}, " for k in keys) + PARTIALS
    return merged_checkpoints(spark.read.schema(schema).parquet(f"{path.rstrip('/')}/batch=*"), runs, interval_s, keys, keys)


def latest_labels(kv_stream: DataFrame, keys: Sequence[str] = ("run_id", "slot", "field")) -> DataFrame:
    """Latest label per slot field (update / complete output mode); ties on time go to the
    later status and the later position inside it."""
    return kv_stream.groupBy(*keys).agg(F.max_by("value", F.struct("ts_us", "diag_seq", "pos")).alias("value"))


def snapshot_writer(path: str, fmt: str = "parquet"):
    """``foreachBatch`` callback that makes the batch the newest snapshot under ``path``
    (:func:`tickflow.sources.sinks.read_snapshot`); an empty batch leaves the one before."""
    from tickflow.sources.sinks import write_snapshot

    def write(batch: DataFrame, epoch_id: int) -> None:
        write_snapshot(batch, path, fmt)

    return write
