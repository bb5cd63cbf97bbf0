"""Alignment and context joins (J1, J2, J4-J8, tumbling counts).

The as-of alignment and the positional pairing are one pass over the union of both sides in time
order, dealt once by (key, block of BLOCK_US): inside a block a running window, across blocks what
the block table carries (one row a block that has rows). So a key is spread over as many tasks as its
run has blocks. Catalyst's private as-of join is not used (it rewrites into a join plus aggregate
over all candidate pairs).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_US = 600 * 1000000  # time that one task windows at once; for topics over some 1 kHz take less


def align_asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    right_cols: Sequence[str],
    *,
    right_order: Sequence[str] | None = None,
    tolerance_us: int | None = None,
    block_us: int = BLOCK_US,
    prefix: str = "r_",
) -> DataFrame:
    """For each left row, the latest right row with ``right_time <= left_time`` in ``by``.

    Right columns come back as ``r_<name>`` plus ``r_time``; NULL when no right row precedes or
    when it is older than ``tolerance_us``. Both times are µs longs; rows without a time or key take
    no part on the right and get NULLs on the left. A right row at the same instant as a left row is
    visible to it. Of right rows at one instant the greatest by ``right_order`` counts (by default by
    ``right_cols``, so the answer never depends on the order of the input).

    The last right row of every block is carried over the blocks by the block table; left rows carry
    their own payload, so there are no row ids and no join back."""
    names = [f"_k{i}" for i in range(len(by))]
    keys = [F.col(c).alias(n) for c, n in zip(by, names)]
    right_row = F.struct(F.col(right_time).alias("time"), F.struct(*[F.col(c) for c in right_order or right_cols]).alias("tie"), F.struct(*[F.col(c).alias(c) for c in right_cols]).alias("row"))
    left_row = F.struct(*[F.col(c) for c in left.columns])
    none = lambda df, row: F.lit(None).cast(df.select(row.alias("x")).schema["x"].dataType)
    rside = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), right_row.alias("_r"), none(left, left_row).alias("_l"))
    lside = left.select(*keys, F.col(left_time).alias("_t"), none(right, right_row).alias("_r"), left_row.alias("_l"))
    rows = rside.unionByName(lside).withColumn("_b", F.expr(f"_t div {int(block_us)}"))
    part = [*names, "_b"]
    ends = rows.groupBy(*part).agg(F.max("_r").alias("_last"))  # the greatest (time, tie) is the last
    prior = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*part, F.last("_last", ignorenulls=True).over(prior).alias("_in"))
    # null keys and times meet nothing; the join keeps them apart from the rest
    same = F.lit(True)
    for c in part:
        same = same & (rows[c] == carry[c])
    inside = Window.partitionBy(*[rows[c] for c in part]).orderBy(rows["_t"], rows["_l"].isNotNull(), rows["_r.tie"]).rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(F.last(rows["_r"], ignorenulls=True).over(inside), carry["_in"])
    out = rows.join(carry, same, "left").select(rows["_t"], rows["_l"], *[rows[c] for c in names], known.alias("_r")).where("_l IS NOT NULL")
    keep = F.col("_t").isNotNull() & F.expr(" AND ".join(f"{n} IS NOT NULL" for n in names))
    if tolerance_us is not None:
        keep = keep & (F.col("_t") - F.col("_r.time") <= tolerance_us)
    cols = [F.when(keep, F.col("_r.time")).alias(f"{prefix}time")] + [F.when(keep, F.col("_r.row").getField(c)).alias(f"{prefix}{c}") for c in right_cols]
    return out.select(*[F.col("_l").getField(c).alias(c) for c in left.columns], *cols)


def with_run_context(df: DataFrame, runs: DataFrame, keys: Sequence[str] = ("run_id", "topic"), time_col: str = "arrival_us") -> DataFrame:
    """Attach run start / duration / rate and the series' max elapsed µs to every row.
    The per-series max is a grouped aggregate joined back, not a whole-series window."""
    mx = df.groupBy(*keys).agg(F.max(time_col).alias("_mx"))
    ctx = runs.join(mx, list(keys), "left").withColumn("series_max_us", F.col("_mx") - F.col("start_us")).drop("_mx")
    return df.join(ctx, list(keys), "left")


def silent_topics(runs: DataFrame, msgs: DataFrame, period_s: int = 1, keys: Sequence[str] = ("run_id", "topic")) -> DataFrame:
    """Expected (run, topic, period) slots inside the run duration with no message at all.
    Expected slots come from the run table (explode of the duration), observed ones from a
    distinct over the messages; the answer is a left-anti join."""
    per = int(period_s * 1000000)
    expected = runs.select(
        *keys,
        F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration_s") / period_s).cast("long") - 1)).alias("second"),
    )
    seen = (
        msgs.join(runs.select(*keys, "start_us"), list(keys))
        .select(*keys, F.expr(f"(arrival_us - start_us) div {per}").alias("second"))
        .distinct()
    )
    return expected.join(seen, [*keys, "second"], "left_anti")


def silences(
    expected: DataFrame, msgs: DataFrame, least_us: int, keys: Sequence[str] = ("run_id", "topic"), block_us: int = 600_000_000
) -> DataFrame:
    """J7 as stretches: (keys, from_us, until_us) of at least ``least_us`` in which an expected topic
    sent nothing, between its ``start_us`` and its end (``duration_s`` later). A topic that sent
    nothing at all is silent from start to end; messages outside that time don't count.

    Gaps inside a block of time come from windows of that block; those across blocks from a table
    with one row a block."""
    plan = expected.select(*keys, "start_us", (F.col("start_us") + (F.col("duration_s") * 1e6).cast("long")).alias("_end"))
    at = F.col("arrival_us")
    seen = msgs.select(*keys, "arrival_us").join(plan, list(keys)).where((at >= F.col("start_us")) & (at <= F.col("_end")))
    seen = seen.select(*keys, "arrival_us", F.expr(f"(arrival_us - start_us) div {int(block_us)}").alias("_b"))
    inside = seen.select(*keys, F.lag("arrival_us").over(Window.partitionBy(*keys, "_b").orderBy("arrival_us")).alias("from_us"), at.alias("until_us"))
    edges = seen.groupBy(*keys, "_b").agg(F.min("arrival_us").alias("_first"), F.max("arrival_us").alias("_last"))
    # the end of the time stands as a last block, so a topic without messages has that row alone
    edges = edges.unionByName(plan.select(*keys, F.lit(None).cast("long").alias("_b"), F.col("_end").alias("_first"), F.col("_end").alias("_last")))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_last()))
    across = edges.withColumn("_before", before).join(plan, list(keys)).select(*keys, F.coalesce("_before", "start_us").alias("from_us"), F.col("_first").alias("until_us"))
    return inside.unionByName(across).where(F.col("until_us") - F.col("from_us") >= int(least_us))


def tumbling_counts(msgs: DataFrame, origin_us: int, seconds: int = 1, keys: Sequence[str] = ("run_id", "topic")) -> DataFrame:
    """X4 in batch form: messages, bytes and points per fixed interval per topic."""
    from tickflow.functions.scalars import message_size, point_count

    width = int(seconds * 1000000)
    return msgs.groupBy(*keys, F.expr(f"(arrival_us - {int(origin_us)}) div {width}").alias("window_s")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(message_size()).alias("bytes"),
        F.sum(point_count()).alias("points"),
    )


def truncate_to_shortest(a: DataFrame, b: DataFrame, keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Pair the i-th values of two indexed series up to the shorter length (inner equi-join
    on the index)."""
    return a.join(b, [*keys, idx], "inner")


def attach_slot_labels(series: DataFrame, labels: DataFrame, keys: Sequence[str] = ("run_id", "slot"), how: str = "left") -> DataFrame:
    """Label slot series with their latest holder (inner for charts, left for tables).
    The label table has at most 20 rows per run; AQE broadcasts it on its measured size."""
    return series.join(labels, list(keys), how)


def watched_process(procs: DataFrame, needle: str, keys: Sequence[str] = ("run_id", "host"), sample_col: str = "sample_seq") -> DataFrame:
    """The first process (lowest pid) whose name contains ``needle`` per host, and its CPU,
    memory and threads at every sample of the host (0 where it no longer exists; no
    ``process_threads`` if ``procs`` has no ``threads``)."""
    chosen = procs.where(F.col("name").contains(needle)).groupBy(*keys).agg(F.min("pid").alias("watched_pid"))
    samples = procs.select(*keys, sample_col).distinct()
    rows = procs.join(chosen, list(keys)).where(F.col("pid") == F.col("watched_pid"))
    counted = ["threads"] if "threads" in procs.columns else []
    return (
        samples.join(chosen, list(keys))
        .join(rows.select(*keys, sample_col, "cpu_percent", "rss_bytes", *counted), [*keys, sample_col], "left")
        .select(
            *keys,
            sample_col,
            "watched_pid",
            F.coalesce(F.col("cpu_percent"), F.lit(0.0)).alias("process_cpu_percent"),
            F.coalesce(F.col("rss_bytes").cast("double") / F.lit(1048576.0), F.lit(0.0)).alias("process_memory_mb"),
            *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"process_{c}") for c in counted],
        )
    )


def positional_zip(
    metrics: DataFrame,
    system: DataFrame,
    keys: Sequence[str] = ("run_id",),
    time_col: str = "elapsed_us",
    order_col: str = "seq",
    *,
    block_us: int = BLOCK_US,
) -> DataFrame:
    """The recorder's positional pairing. The k-th *accepted* system sample is paired with
    the k-th metrics timestamp; a system sample is accepted only while fewer system values
    than timestamps exist.

    With T_n = metrics timestamps seen by system sample n and a_n = accepted among the first n
    samples, a_n = n + min(0, min_{m<=n}(T_m − m)); sample n is accepted iff a_n > a_{n−1}. All of it
    comes from one pass in the order (time, metrics first, ``order_col``): T and n are running counts,
    the minimum is a running one, and each starts in a block from what the block table carries. The
    pairs are a grouped aggregate on k."""
    side = lambda df, s: df.select(*keys, F.col(time_col).alias("_t"), F.lit(s).alias("_s"), F.col(order_col).alias("_o"))
    part = [*keys, "_b"]
    rows = side(metrics, 0).unionByName(side(system, 1)).withColumn("_b", F.expr(f"_t div {int(block_us)}")).repartition(*part)
    inside = Window.partitionBy(*part).orderBy("_t", "_s", "_o")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.sum(1 - F.col("_s")).over(upto).alias("_m"), F.sum("_s").over(upto).alias("_n"))
    rows = rows.select("*", F.when(F.col("_s") == 1, F.col("_m") - F.col("_n")).alias("_d"))
    # per block: how many of both, and the least T - n of its system samples, all counted from its start
    ends = rows.groupBy(*part).agg(F.max("_m").alias("_bm"), F.max("_n").alias("_bn"), F.min("_d").alias("_bd"))
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*part, "_bd", F.coalesce(F.sum("_bm").over(prior), F.lit(0)).alias("_om"), F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_on"))
    carry = carry.select(*part, "_om", "_on", F.least(F.lit(0), F.min(F.expr("_bd + _om - _on")).over(prior)).alias("_least"))
    rows = rows.select("*", F.min("_d").over(upto).alias("_in"), F.min("_d").over(before).alias("_ex")).join(carry, part)
    low = lambda c: F.expr(f"least(_least, {c} + _om - _on)")  # noqa: E731  nulls don't count
    n = F.col("_on") + F.col("_n")
    rows = rows.select(*keys, "_t", "_s", "_o", (F.col("_om") + F.col("_m")).alias("_km"), (n + low("_in")).alias("_an"), (n - 1 + low("_ex")).alias("_ap"))
    rows = rows.where("_s = 0 OR _an > _ap").select(*keys, F.expr("CASE WHEN _s = 0 THEN _km ELSE _an END").alias("k"), "_t", "_s", "_o")
    own = lambda c, s: F.max(F.when(F.col("_s") == s, F.col(c)))  # noqa: E731  one row a side and k
    pairs = rows.groupBy(*keys, "k").agg(own("_t", 0).alias("metrics_time"), own("_o", 1).alias("sys_seq"), own("_t", 1).alias("sys_time"))
    return pairs.where("metrics_time IS NOT NULL AND sys_seq IS NOT NULL").select(*keys, "k", "metrics_time", "sys_seq", "sys_time")
