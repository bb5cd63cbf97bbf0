"""Column-level scalar functions (projections, unit conversion, text and key helpers).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickflow.schemas import CMDLINE_MAX_CHARS, THERMAL_ZONES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# P1 / P2 -------------------------------------------------------------------------------
def message_size(data_len: Column | str = "data_len", width="width", height="height", point_step="point_step") -> Column:
    """Payload length, or width·height·point_step when the payload is empty."""
    fallback = _c(width).cast("long") * _c(height).cast("long") * _c(point_step).cast("long")
    return F.when(_c(data_len) > 0, _c(data_len).cast("long")).otherwise(fallback)


def point_count(width="width", height="height") -> Column:
    return _c(width).cast("long") * _c(height).cast("long")


# P3 ---------------------------------------------------------------------------------------
_UNITS = {
    "s_to_ms": lambda c: c * F.lit(1000.0),
    "us_to_ms": lambda c: c / F.lit(1000.0),
    "us_to_s": lambda c: c / F.lit(1e6),
    "bytes_per_s_to_mbps": lambda c: c * F.lit(8.0) / F.lit(1e6),
    "bytes_to_kib": lambda c: c / F.lit(1024.0),
    "bytes_to_mb": lambda c: c / F.lit(1e6),
    "bytes_to_mib": lambda c: c / F.lit(1048576.0),
    "bytes_to_gib": lambda c: c / F.lit(1073741824.0),
    "points_to_k": lambda c: c / F.lit(1000.0),
    "points_to_m": lambda c: c / F.lit(1e6),
    "millic_to_c": lambda c: c / F.lit(1000.0),
}


def convert_units(col: Column | str, kind: str) -> Column:
    """Unit conversions used by the metrics: KB = 1024 B, MB = 1e6 B, MiB/GiB = 2^20/2^30 B."""
    if kind not in _UNITS:
        raise ValueError(f"unknown unit conversion {kind!r}; known: {sorted(_UNITS)}")
    return _UNITS[kind](_c(col).cast("double"))


# P9 ---------------------------------------------------------------------------------------
def elapsed_seconds(ts_us: Column | str, start_us: Column | str) -> Column:
    return (_c(ts_us) - _c(start_us)).cast("double") / F.lit(1e6)


# P10 / P11 / P12 --------------------------------------------------------------------------
def process_display_name(name="name", pid="pid") -> Column:
    """``"name (PID:n)"``; ``"PID:n"`` when the name is empty and pid > 0; else ``''``."""
    n, p = _c(name), _c(pid)
    return (
        F.when((n.isNotNull()) & (n != ""), F.format_string("%s (PID:%d)", n, p.cast("long")))
        .when(p > 0, F.format_string("PID:%d", p.cast("long")))
        .otherwise(F.lit(""))
    )


def truncate_text(col: Column | str, n: int = CMDLINE_MAX_CHARS) -> Column:
    return F.substring(_c(col), 1, n)


def normalise_cpu(cpu: Column | str, cores: Column | str) -> Column:
    return F.when(_c(cores) > 0, _c(cpu) / _c(cores)).otherwise(_c(cpu))


# P13 / P14 / P15 / P16 --------------------------------------------------------------------
def zone_mean_temperature(zone_millic_cols: list[str]) -> Column:
    """Mean °C over the thermal zones that could be read (non-null); NULL when none."""
    temps = F.filter(F.array(*[_c(c).cast("double") / F.lit(1000.0) for c in zone_millic_cols]), lambda x: x.isNotNull())
    total = F.aggregate(temps, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(temps) > 0, total / F.size(temps))


def sensor_mean_temperature(sensors: Column | str = "sensors") -> Column:
    """Mean of sensors whose group name or label contains ``cpu`` (any case); NULL when none."""
    cpu = F.filter(
        _c(sensors), lambda s: F.lower(s["grp"]).contains("cpu") | F.lower(s["label"]).contains("cpu")
    )
    total = F.aggregate(cpu, F.lit(0.0), lambda acc, s: acc + s["current"])
    return F.when(F.size(cpu) > 0, total / F.size(cpu))


def zone_from_key(key: Column | str) -> Column:
    """``jetson_<zone>_temp_c`` → ``<zone>``; NULL for other keys."""
    k = _c(key)
    return F.when(k.rlike("^jetson_.*_temp_c$"), F.regexp_extract(k, "^jetson_(.*)_temp_c$", 1))


def slot_from_key(key: Column | str) -> Column:
    """``top_process_<n>_<field>`` → struct(slot n-1 in 0..19, field in name/cmdline/exe/cwd)."""
    k = _c(key)
    pattern = "^top_process_([0-9]+)_(name|cmdline|exe|cwd)$"
    n = F.regexp_extract(k, pattern, 1).try_cast("int")
    slot = n - 1
    ok = k.rlike(pattern) & slot.between(0, 19)
    return F.when(ok, F.struct(slot.alias("slot"), F.regexp_extract(k, pattern, 2).alias("field")))


# P17 / P18 --------------------------------------------------------------------------------
def time_axis_unit(max_elapsed_s: Column | str) -> Column:
    m = _c(max_elapsed_s)
    return F.when(m >= 86400, F.lit("days")).when(m >= 3600, F.lit("hours")).otherwise(F.lit("seconds"))


def time_axis_divisor(max_elapsed_s: Column | str) -> Column:
    m = _c(max_elapsed_s)
    return F.when(m >= 86400, F.lit(86400.0)).when(m >= 3600, F.lit(3600.0)).otherwise(F.lit(1.0))


def checkpoint_label(elapsed_days: Column | str) -> Column:
    return F.format_string("Day%.1f", _c(elapsed_days).cast("double"))


def stamp_text(ts: Column | str) -> Column:
    """``yyyyMMdd_HHmmss`` stamp (session time zone, UTC)."""
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")


# P21 --------------------------------------------------------------------------------------
def fixed_text(col: Column | str, places: int = 2) -> Column:
    """A double with so many decimals, made from integers (halves go away from zero), so that
    any engine gives the same text; ``nan`` and ``inf`` by name."""
    x = _c(col).cast("double")
    one = 10**places
    units = F.floor(F.abs(x) * F.lit(float(one)) + F.lit(0.5)).cast("bigint")
    sign = F.when((x < 0) & (units > 0), F.lit("-")).otherwise(F.lit(""))
    whole = (units - units % one) / F.lit(one)
    text = F.concat(sign, whole.cast("decimal(20,0)").cast("string"))
    if places:
        text = F.concat(text, F.lit("."), F.lpad((units % one).cast("string"), places, "0"))
    wide = F.abs(x) >= float(1 << 53) / one  # no such decimals any more
    return F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf"))).when(
        wide, F.format_string(f"%.{places}f", x)
    ).otherwise(text)


def format_value(col: Column | str, places: int = 2, na_when_null: bool = True) -> Column:
    """Fixed decimals for display; ``N/A`` when there is no valid value."""
    c = _c(col)
    text = fixed_text(c, places)
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit("N/A")).otherwise(text) if na_when_null else text


# Text → number guard shared by the kv parser: what both Spark and DuckDB read as a float.
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def parse_number(text: Column | str) -> Column:
    """Float value of a kv text when it reads as a number (incl. nan/inf), else NULL."""
    t = _c(text)
    return F.when(t.rlike(NUMBER_PATTERN), F.trim(t).try_cast("double"))


__all__ = [
    "message_size",
    "point_count",
    "convert_units",
    "elapsed_seconds",
    "process_display_name",
    "truncate_text",
    "normalise_cpu",
    "zone_mean_temperature",
    "sensor_mean_temperature",
    "zone_from_key",
    "slot_from_key",
    "time_axis_unit",
    "time_axis_divisor",
    "checkpoint_label",
    "stamp_text",
    "fixed_text",
    "format_value",
    "parse_number",
    "THERMAL_ZONES",
]
