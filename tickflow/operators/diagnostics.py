"""Diagnostic status operators: routing, key/value parsing, latest labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickflow.functions.rules import route_status
from tickflow.functions.scalars import fixed_text, parse_number, slot_from_key, zone_from_key


def explode_kv(diag: DataFrame, keys: Sequence[str] = ("run_id", "diag_seq")) -> DataFrame:
    """One row per key/value pair with its position in the status (duplicates kept)."""
    return diag.select(*keys, "ts_us", "name", F.posexplode("values").alias("pos", "kv")).select(
        *keys, "ts_us", "name", "pos", F.col("kv.key").alias("key"), F.col("kv.value").alias("value")
    )


def last_wins(values: Column | str = "values") -> Column:
    """Keep, per key, only the last entry of a key/value list (duplicate keys: last wins).

    Evaluated inside each status row (a status holds all its pairs), so no shuffle is needed;
    the session-wide map dedup policy is left alone."""
    v = F.col(values) if isinstance(values, str) else values
    return F.filter(v, lambda x, i: ~F.exists(F.slice(v, i + 2, F.size(v)), lambda y: y["key"] == x["key"]))


def parse_kv(diag: DataFrame, keys: Sequence[str] = ("run_id", "diag_seq")) -> DataFrame:
    """Per status and key, the last value (duplicate keys: last wins), as number when it
    reads as a float, else kept as text. Row-local: dedup inside the list, then explode."""
    kv = diag.select(*keys, F.explode(last_wins("values")).alias("kv")).select(
        *keys, F.col("kv.key").alias("key"), F.col("kv.value").alias("value")
    )
    num = parse_number("value")
    return kv.select(*keys, "key", num.alias("num"), F.when(num.isNull(), F.col("value")).alias("text"))


def routed(diag: DataFrame, exact: bool = False) -> DataFrame:
    """tag statuses ``stream`` / ``system`` and drop the others."""
    return diag.withColumn("route", route_status("name", exact)).where(F.col("route").isNotNull())


def latest_by_key(diag: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Last seen name/cmdline/exe/cwd per process slot (system statuses only)."""
    kv = explode_kv(routed(diag, exact=True).where(F.col("route") == "system"), [*keys, "diag_seq"])
    sk = kv.withColumn("_s", slot_from_key("key")).where(F.col("_s").isNotNull())
    return sk.groupBy(*keys, F.col("_s.slot").alias("slot"), F.col("_s.field").alias("field")).agg(
        F.max_by(F.col("value"), F.struct(F.col("ts_us"), F.col("diag_seq"), F.col("pos"))).alias("value")
    )


def zone_values(diag: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """P15 over the system statuses: (keys, zone, celsius) rows of ``jetson_<zone>_temp_c``."""
    kv = parse_kv(routed(diag).where(F.col("route") == "system"), [*keys, "diag_seq"])
    z = kv.withColumn("zone", zone_from_key("key")).where(F.col("zone").isNotNull() & F.col("num").isNotNull())
    return z.select(*keys, "diag_seq", "zone", F.col("num").alias("celsius"))


def format_kv(metrics: DataFrame, names: Sequence[str], places: int, keys: Sequence[str]) -> DataFrame:
    """The named metrics as (keys, key, value) rows of text with fixed decimals (the streams
    publish 3, the hosts 2); a missing metric is 0."""
    kv = F.array(*[F.struct(F.lit(n).alias("key"), fixed_text(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), places).alias("value")) for n in names])
    return metrics.select(*keys, F.explode(kv).alias("_kv")).select(*keys, "_kv.key", "_kv.value")
