"""Positional wire vectors (P4-P6): named metrics ↔ ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickflow.schemas import METRICS_VECTOR, SYSTEM_BASE, SYSTEM_VECTOR_MIN_LEN, TOP_SLOTS

NAN = float("nan")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_metrics_vector(cols: list[str] | None = None) -> Column:
    """The 9 metrics in wire order, missing → 0.0."""
    names = cols or METRICS_VECTOR
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])


def decode_metrics_vector(data: Column | str = "data", on_short: str = "nan") -> Column:
    """P5: struct of the 9 named metrics. Vectors shorter than 9: ``nan`` fills NaN (long-term
    recorder), ``skip`` leaves NULL (the short recorder stores the time but no values)."""
    d = _c(data)
    ok = F.size(d) >= len(METRICS_VECTOR)
    if on_short not in ("nan", "skip"):
        raise ValueError("on_short must be 'nan' or 'skip'")
    fill = F.lit(NAN) if on_short == "nan" else F.lit(None).cast("double")
    return F.struct(*[F.when(ok, F.get(d, i)).otherwise(fill).alias(name) for i, name in enumerate(METRICS_VECTOR)])


def encode_system_vector(base: list[Column], slots: Column, zones: Column | None = None) -> Column:
    """P6 encode: 7 base values, then per slot (memory MB, CPU %) for exactly 20 slots, then the
    zone temperatures that are present. ``slots`` is an array<struct<memory_mb, cpu_percent>>
    (padded to 20 by :func:`tickflow.operators.processes.pad_slots`)."""
    flat = F.flatten(F.transform(slots, lambda s: F.array(s["memory_mb"].cast("double"), s["cpu_percent"].cast("double"))))
    parts = [F.array(*[F.coalesce(b.cast("double"), F.lit(0.0)) for b in base]), flat]
    if zones is not None:
        parts.append(F.filter(zones, lambda z: z.isNotNull()))
    return F.concat(*parts)


def decode_system_vector(data: Column | str = "data") -> Column:
    """P6 decode: struct(base 7 values, 20 slots, trailing zone values).

    Length < 7 → every value NaN; 7..46 → base kept, all slots NaN; >= 47 → slots read from
    positions 7+2i / 8+2i. Values past 47 are the zones that were present (unlabelled)."""
    d = _c(data)
    n = F.size(d)
    has_base = n >= len(SYSTEM_BASE)
    has_slots = n >= SYSTEM_VECTOR_MIN_LEN
    nan = F.lit(NAN)
    base = [F.when(has_base, F.get(d, i)).otherwise(nan).alias(name) for i, name in enumerate(SYSTEM_BASE)]
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(TOP_SLOTS - 1)),
        lambda i: F.struct(
            i.alias("slot"),
            F.when(has_slots, F.get(d, i * 2 + 7)).otherwise(nan).alias("memory_mb"),
            F.when(has_slots, F.get(d, i * 2 + 8)).otherwise(nan).alias("cpu_percent"),
        ),
    )
    zones = F.when(n > SYSTEM_VECTOR_MIN_LEN, F.slice(d, F.lit(SYSTEM_VECTOR_MIN_LEN + 1), n - SYSTEM_VECTOR_MIN_LEN)).otherwise(F.array().cast("array<double>"))
    return F.struct(*base, slots.alias("slots"), zones.alias("zones"))
