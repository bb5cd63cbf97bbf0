"""Query registry: one composed Spark query per operator of the inventory, each with its
DuckDB oracle SQL when the operator is SQL-expressible.

Every query reads the driver's tables through the projections in
:mod:`tickflow.sources.fixtures`, so its work grows with the data. Double outputs of
aggregates are rounded to 6 decimals in both engines (summation order differs between
engines); per-row metrics are computed with the same IEEE operation order in both and are
compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = portable_round_sql(sql)
        return fn

    return deco


# Rounding that both engines evaluate with the same IEEE operations: floor(x·10^d + 0.5)/10^d.
# Engine ``round`` functions differ (decimal text vs binary value, half-up vs half-even), which
# flips last digits of ties and of large magnitudes. From 2^53/10^d on a double has no such digit
# (and floor, a bigint in Spark, would saturate): the value stays as it is.
EXACT = float(1 << 53)


def fround(col, places: int = 6):
    if isinstance(col, str):
        # one SQL expression: a single call to the JVM instead of one per operator
        c = f"`{col}`"
        return F.expr(f"CASE WHEN isnan({c}) OR abs({c}) >= {EXACT / 10**places!r}D THEN {c} ELSE floor({c} * 1e{places}D + 0.5D) / 1e{places}D END")
    scale = float(10**places)
    return F.when(F.isnan(col) | (F.abs(col) >= EXACT / scale), col).otherwise(F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale))


def _sql_fround(expr: str, places: str) -> str:
    scale = f"1e{int(places)}"
    return f"(CASE WHEN isnan(({expr})) OR abs(({expr})) >= {EXACT / 10 ** int(places)!r}::DOUBLE THEN ({expr}) ELSE floor(({expr}) * {scale} + 0.5) / {scale} END)"


def portable_round_sql(sql: str) -> str:
    """Rewrite every ``round(expr, d)`` of an oracle query into the portable form."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        if comma < 0:
            out.append(sql[i:k])
        else:
            expr, places = sql[j + 6 : comma], sql[comma + 1 : k - 1].strip()
            out.append(sql[i:j] + _sql_fround(portable_round_sql(expr), places))
        i = k


def sql_fixed(x: str, places: int, null: str = "'N/A'") -> str:
    """DuckDB text of a double with fixed decimals, from integers; `null` for NULL and NaN."""
    units = f"CAST(floor(abs({x}) * 1e{places} + 0.5) AS BIGINT)"
    tail = f" || '.' || lpad(CAST({units} % {10**places} AS VARCHAR), {places}, '0')" if places else ""
    return (
        f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN {null} WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END "
        f"ELSE CASE WHEN {x} < 0 AND {units} > 0 THEN '-' ELSE '' END || CAST({units} // {10**places} AS VARCHAR){tail} END)"
    )


def round_doubles(df: DataFrame, places: int = 6, text_arrays: dict[str, str] | None = None) -> DataFrame:
    """Round every double column (aggregates whose summation order is engine-specific) and
    join the listed string arrays with their separator, in one projection."""
    text_arrays = text_arrays or {}
    cols = []
    for f in df.schema.fields:
        if f.name in text_arrays:
            cols.append(F.array_join(F.col(f.name), text_arrays[f.name]).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(fround(f.name, places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
