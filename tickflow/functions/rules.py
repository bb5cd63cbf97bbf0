"""Rule chains (levels, ratings, recommendations, routing) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickflow import schemas as S


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F1 ---------------------------------------------------------------------------------------
def route_status(name: Column | str = "name", exact: bool = False) -> Column:
    """``stream`` / ``system`` / NULL by status name (substring test; equality when ``exact``)."""
    n = _c(name)
    if exact:
        return F.when(n.startswith(S.STREAM_STATUS_PREFIX + ":"), F.lit("stream")).when(
            n == S.SYSTEM_STATUS_NAME, F.lit("system")
        )
    return F.when(n.contains(S.STREAM_STATUS_PREFIX), F.lit("stream")).when(
        n.contains(S.SYSTEM_STATUS_NAME), F.lit("system")
    )


# F2 / F3 ------------------------------------------------------------------------------------
def valid_number(v: Column | str) -> Column:
    c = _c(v)
    return c.isNotNull() & ~F.isnan(c)


def positive_only(v: Column | str) -> Column:
    c = _c(v)
    return F.when(c > 0, c)


# F4 -----------------------------------------------------------------------------------------
def within_duration(df, runs, keys=("run_id", "topic"), time_col: str = "arrival_us"):
    """rows whose elapsed time since the run start is below the configured duration
    (the analysis window). ``runs`` is one row per key: joined by AQE's measured strategy."""
    j = df.join(runs.select(*keys, "start_us", "duration_s"), list(keys))
    elapsed = (F.col(time_col) - F.col("start_us")).cast("double") / F.lit(1e6)
    return j.where(elapsed < F.col("duration_s")).drop("start_us", "duration_s")


# F5 -----------------------------------------------------------------------------------------
def stream_level(hz: Column | str = "current_hz", jitter: Column | str = "jitter_ms") -> Column:
    """struct(level, message): low frequency first, then high jitter, else OK."""
    h, j = F.coalesce(_c(hz), F.lit(0.0)), F.coalesce(_c(jitter), F.lit(0.0))
    level = F.when(h < 5, F.lit(S.LEVEL_WARN)).when(j > 50, F.lit(S.LEVEL_WARN)).otherwise(F.lit(S.LEVEL_OK))
    msg = (
        F.when(h < 5, F.lit(S.MSG_LOW_FREQUENCY))
        .when(j > 50, F.lit(S.MSG_HIGH_JITTER))
        .otherwise(F.lit(S.MSG_OPERATING_NORMALLY))
    )
    return F.struct(level.alias("level"), msg.alias("message"))


# F6 -----------------------------------------------------------------------------------------
def system_level(cpu: Column | str = "cpu_percent", mem: Column | str = "memory_percent") -> Column:
    """struct(level, message) in the order cpu > 90, cpu > 70, mem > 90, mem > 70."""
    c, m = F.coalesce(_c(cpu), F.lit(0.0)), F.coalesce(_c(mem), F.lit(0.0))
    level = (
        F.when(c > 90, F.lit(S.LEVEL_ERROR))
        .when(c > 70, F.lit(S.LEVEL_WARN))
        .when(m > 90, F.lit(S.LEVEL_ERROR))
        .when(m > 70, F.lit(S.LEVEL_WARN))
        .otherwise(F.lit(S.LEVEL_OK))
    )
    msg = (
        F.when(c > 90, F.lit(S.MSG_CPU_CRITICAL))
        .when(c > 70, F.lit(S.MSG_CPU_HIGH))
        .when(m > 90, F.lit(S.MSG_MEMORY_CRITICAL))
        .when(m > 70, F.lit(S.MSG_MEMORY_HIGH))
        .otherwise(F.lit(S.MSG_SYSTEM_NORMAL))
    )
    return F.struct(level.alias("level"), msg.alias("message"))


# F7 / F8 ------------------------------------------------------------------------------------
def performance_rating(avg_hz: Column | str, has_data: Column | None = None) -> Column:
    h = _c(avg_hz)
    r = (
        F.when(h >= 20, F.lit(S.RATING_EXCELLENT))
        .when(h >= 10, F.lit(S.RATING_GOOD))
        .when(h >= 5, F.lit(S.RATING_FAIR))
        .otherwise(F.lit(S.RATING_POOR))
    )
    return r if has_data is None else F.when(has_data, r).otherwise(F.lit(S.RATING_NO_DATA))


def stability_rating(avg_jitter_ms: Column | str, has_data: Column | None = None) -> Column:
    j = _c(avg_jitter_ms)
    r = (
        F.when(j <= 10, F.lit(S.RATING_EXCELLENT))
        .when(j <= 25, F.lit(S.RATING_GOOD))
        .when(j <= 50, F.lit(S.RATING_FAIR))
        .otherwise(F.lit(S.RATING_POOR))
    )
    return r if has_data is None else F.when(has_data, r).otherwise(F.lit(S.RATING_NO_DATA))


# F9 -----------------------------------------------------------------------------------------
def recommendations(
    avg_hz: Column | str | None = None,
    avg_jitter_ms: Column | str | None = None,
    avg_bandwidth_mbps: Column | str | None = None,
    avg_cpu: Column | str | None = None,
    avg_memory: Column | str | None = None,
) -> Column:
    """Ordered recommendation list; a NULL input (missing block) skips its rule; no hit gives
    the single 'normal' entry."""
    rules = []
    if avg_hz is not None:
        rules.append(F.when(_c(avg_hz) < 10, F.lit(S.REC_LOW_FREQUENCY)))
    if avg_jitter_ms is not None:
        rules.append(F.when(_c(avg_jitter_ms) > 50, F.lit(S.REC_HIGH_JITTER)))
    if avg_bandwidth_mbps is not None:
        rules.append(F.when(_c(avg_bandwidth_mbps) > 100, F.lit(S.REC_HIGH_BANDWIDTH)))
    if avg_cpu is not None:
        rules.append(F.when(_c(avg_cpu) > 80, F.lit(S.REC_HIGH_CPU)))
    if avg_memory is not None:
        rules.append(F.when(_c(avg_memory) > 80, F.lit(S.REC_HIGH_MEMORY)))
    hits = F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return F.when(F.size(hits) == 0, F.array(F.lit(S.REC_NORMAL))).otherwise(hits)


# F10 ----------------------------------------------------------------------------------------
def target_band(value: Column | str, good_above: float | None = None, good_below: float | None = None,
                poor_below: float | None = None, poor_above: float | None = None) -> Column:
    """``good`` / ``needs improvement`` / ``acceptable`` against documented targets."""
    v = _c(value)
    good = F.lit(True)
    if good_above is not None:
        good = good & (v > good_above)
    if good_below is not None:
        good = good & (v < good_below)
    poor = F.lit(False)
    if poor_below is not None:
        poor = poor | (v < poor_below)
    if poor_above is not None:
        poor = poor | (v > poor_above)
    return F.when(v.isNull(), F.lit(None).cast("string")).when(good, F.lit("good")).when(poor, F.lit("needs improvement")).otherwise(
        F.lit("acceptable")
    )


# F14 ----------------------------------------------------------------------------------------
def rating_palette(rating: Column | str) -> Column:
    r = _c(rating)
    expr = None
    for name, colour in S.RATING_COLOURS.items():
        expr = F.when(r == name, F.lit(colour)) if expr is None else expr.when(r == name, F.lit(colour))
    return expr.otherwise(F.lit(S.RATING_COLOUR_DEFAULT))
