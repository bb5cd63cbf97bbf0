"""Oracle parity: Spark queries vs their DuckDB SQL on the driver's tables.

Default: a representative subset at sf0.001. ``TICKFLOW_FULL=1``: every query at sf0.01."""

import os

import pytest

from conftest import SF_MID, SF_SMALL

FULL = os.environ.get("TICKFLOW_FULL") == "1"
SUBSET = [
    "stream_summary",
    "tick_metrics",
    "last_n_interval_stats",
    "align_asof",
    "positional_zip",
    "top_n_per_sample",
    "pad_slots",
    "parse_kv",
    "decode_system_vector",
    "cumulative_checkpoints",
    "minmax_downsample",
    "build_report",
    "log_pattern_report",
    "live_gauges",
]


def _names():
    from tickflow.plans import load_all

    _, oracles = load_all()
    return sorted(oracles) if FULL else SUBSET


@pytest.fixture(scope="module")
def duck():
    from tools.oracle_check import duck_connect

    return duck_connect(SF_MID if FULL else SF_SMALL)


@pytest.mark.parametrize("name", _names())
def test_oracle_parity(spark, duck, name):
    from tools.oracle_check import compare

    res = compare(spark, name, SF_MID if FULL else SF_SMALL, duck)
    assert res.get("cols_match"), res
    assert res.get("types_match"), res
    assert res.get("match"), res


def test_registry_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert {"performance_rating", "stability_rating", "average_hz"} <= set(df.columns)
