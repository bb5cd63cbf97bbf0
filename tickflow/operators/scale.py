"""Scale utilities: ordered-window work without putting one key's whole history in one task.

A plain ``Window.partitionBy(run, topic).orderBy(seq)`` sends every row of a topic to one
task. One hot topic can hold a third of all rows, so the ordered operators are built from
the pieces below instead. Every piece is a composition of grouped aggregates over small
tables, equi-joins and windows over *bounded* partitions; nothing is collected.

* :func:`dense_index`   0-based position of each row inside its key, plus inclusive running
                        sums of chosen columns; rows are only ever sorted inside a bounded
                        range bucket of the order column.
* :func:`halo_blocks`   cut a dense index into blocks of ``block_rows`` rows and copy the last
                        ``halo`` rows of each block into the next one, so that last-N row
                        frames (N <= halo) can be evaluated per (key, block).
* :func:`blocked_running_sum` / :func:`blocked_carry_forward`
                        running sums and last-non-null fills over an ordered column, split in
                        blocks: per-block partials, a prefix over the (small) block table,
                        then a per-block window plus the carried value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default sizes. A bucket/block holds at most this many rows of one key, so one window
# partition stays within a task's memory at any data volume.
DEFAULT_BUCKET_WIDTH = 1 << 20  # in units of the order column (seq numbers)
DEFAULT_BLOCK_ROWS = 1 << 20
DEFAULT_TICK_BLOCK = 1 << 16


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in names]


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    *,
    bucket_width: int = DEFAULT_BUCKET_WIDTH,
    cumulative: Sequence[str] = (),
    idx_col: str = "idx",
) -> DataFrame:
    """Add ``idx`` = 0-based rank of ``order_col`` inside ``keys`` and ``cum_<c>`` running sums.

    ``order_col`` must be an integral column unique within ``keys`` (an arrival sequence or
    µs time). Steps: range bucket → per-(key, bucket) counts and sums (partial aggregation,
    small output) → exclusive prefix over the bucket table → equi-join back → row_number and
    running sums inside the bucket. The only full-data shuffle is the one on (key, bucket);
    the bucket table has one row per (key, bucket) and is joined by whatever strategy AQE
    measures to be cheapest.
    """
    bucketed = df.withColumn("_bkt", F.expr(f"`{order_col}` div {int(bucket_width)}"))
    sums = [F.sum(c).alias(f"_bs_{c}") for c in cumulative]
    table = bucketed.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_bn"), *sums)
    prior = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.select(
        *keys,
        "_bkt",
        F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_bs_{c}").over(prior), F.lit(0)).alias(f"_off_{c}") for c in cumulative],
    )
    joined = bucketed.join(offsets, [*keys, "_bkt"], "inner")
    inside = Window.partitionBy(*keys, "_bkt").orderBy(order_col)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    # one projection (each DataFrame call re-analyses the whole plan)
    return joined.select(
        *[c for c in df.columns],
        (F.col("_off") + F.row_number().over(inside) - 1).alias(idx_col),
        *[(F.col(f"_off_{c}") + F.sum(c).over(running)).alias(f"cum_{c}") for c in cumulative],
    )


def halo_blocks(
    df: DataFrame,
    idx_col: str,
    *,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    halo: int,
    block_col: str = "_blk",
    halo_col: str = "_halo",
) -> DataFrame:
    """Assign ``block = idx div block_rows``; rows among the last ``halo`` of a block are also
    emitted into the next block with ``_halo = true``. Costs one extra halo/block_rows of data."""
    if halo > block_rows:
        raise ValueError("halo must not exceed block_rows")
    blk = F.expr(f"`{idx_col}` div {int(block_rows)}")
    pos = F.expr(f"`{idx_col}` % {int(block_rows)}")
    targets = F.when(pos >= block_rows - halo, F.array(blk, blk + 1)).otherwise(F.array(blk))
    exploded = df.select("*", F.explode(targets).alias("_tb"))
    return exploded.select(
        *[c for c in df.columns], F.col("_tb").cast("long").alias(block_col), (F.col("_tb") != blk).alias(halo_col)
    )


def sliding_min_max(
    df: DataFrame,
    part_keys: Sequence[str],
    idx_col: str,
    value_col: str,
    n: int,
    *,
    min_col: str,
    max_col: str,
) -> DataFrame:
    """min/max of ``value_col`` over the last ``n`` rows (by ``idx``) in linear time.

    Spark evaluates a sliding ``rowsBetween(-(n-1), 0)`` frame by re-aggregating the whole
    frame for every row (O(rows·n)). Here the index is cut into chunks of ``n`` rows; the
    frame of row i spans at most two chunks, so it is the combination of the prefix
    min/max of i's chunk and the suffix min/max (from i-n+1) of the previous chunk. Both are
    running frames. ``part_keys`` must already hold every row back to i-n (halo blocks).
    Nulls are skipped, as in SQL aggregates.
    """
    # ``_chk`` (idx div n) may already be present: callers that order their own windows by
    # (_chk, idx) share one sort with the prefix and lag windows here
    with_chunk = df if "_chk" in df.columns else df.select("*", F.expr(f"`{idx_col}` div {int(n)}").alias("_chk"))
    by_chunk = Window.partitionBy(*part_keys, "_chk")
    pre = by_chunk.orderBy(F.col(idx_col)).rowsBetween(Window.unboundedPreceding, 0)
    suf = by_chunk.orderBy(F.col(idx_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
    step = Window.partitionBy(*part_keys).orderBy("_chk", idx_col)
    v = F.col(value_col)
    cols = list(df.columns)
    if n == 1:
        return df.select(*cols, v.alias(min_col), v.alias(max_col))
    out = with_chunk.select("*", F.min(v).over(pre).alias("_pmin"), F.max(v).over(pre).alias("_pmax"))
    out = out.select("*", F.min(v).over(suf).alias("_smin"), F.max(v).over(suf).alias("_smax"))
    # the suffix value at i-n+1 belongs to the chunk before i's chunk unless i closes a chunk
    lag_smin = F.lag("_smin", n - 1).over(step)
    lag_smax = F.lag("_smax", n - 1).over(step)
    own_chunk_start = F.expr(f"`{idx_col}` % {int(n)}") == n - 1
    return out.select(
        *cols,
        F.when(own_chunk_start, F.col("_pmin")).otherwise(F.least(F.col("_pmin"), lag_smin)).alias(min_col),
        F.when(own_chunk_start, F.col("_pmax")).otherwise(F.greatest(F.col("_pmax"), lag_smax)).alias(max_col),
    )


def blocked_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    cols: Sequence[str],
    *,
    block_width: int = DEFAULT_TICK_BLOCK,
    prefix: str = "run_",
) -> DataFrame:
    """Inclusive running sums of ``cols`` ordered by ``order_col`` within ``keys``, per block.

    ``order_col`` is integral and unique within ``keys`` (e.g. a tick number)."""
    blocked = df.withColumn("_rb", F.expr(f"`{order_col}` div {int(block_width)}"))
    table = blocked.groupBy(*keys, "_rb").agg(*[F.sum(c).alias(f"_rbs_{c}") for c in cols])
    prior = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.select(
        *keys, "_rb", *[F.coalesce(F.sum(f"_rbs_{c}").over(prior), F.lit(0)).alias(f"_rbo_{c}") for c in cols]
    )
    running = Window.partitionBy(*keys, "_rb").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(offsets, [*keys, "_rb"], "inner")
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_rbo_{c}") + F.coalesce(F.sum(c).over(running), F.lit(0)))
    return out.drop("_rb", *[f"_rbo_{c}" for c in cols])


def blocked_carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    col: str,
    *,
    block_width: int = DEFAULT_TICK_BLOCK,
) -> DataFrame:
    """Replace NULLs of ``col`` by the last non-null value before it (by ``order_col``) in
    ``keys``; rows before the first value stay NULL. ``col`` may be a struct, so many gauges
    are carried at once."""
    blocked = df.withColumn("_cb", F.expr(f"`{order_col}` div {int(block_width)}"))
    last_in_block = (
        blocked.where(F.col(col).isNotNull())
        .groupBy(*keys, "_cb")
        .agg(F.max_by(F.col(col), F.col(order_col)).alias("_cb_last"))
    )
    # one row per block present in the input (small table), carry-in = last value of an
    # earlier block
    blocks = blocked.select(*keys, "_cb").distinct().join(last_in_block, [*keys, "_cb"], "left")
    prior = Window.partitionBy(*keys).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    carry_in = blocks.select(*keys, "_cb", F.last("_cb_last", ignorenulls=True).over(prior).alias("_cb_in"))
    running = Window.partitionBy(*keys, "_cb").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.join(carry_in, [*keys, "_cb"], "left").withColumn(
        col, F.coalesce(F.last(F.col(col), ignorenulls=True).over(running), F.col("_cb_in"))
    )
    return out.drop("_cb", "_cb_in")
