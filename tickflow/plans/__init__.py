"""Composed queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

import importlib

_MODULES = [
    "tickflow.plans.stream_queries",
    "tickflow.plans.host_queries",
    "tickflow.plans.series_queries",
    "tickflow.plans.report_queries",
    "tickflow.plans.io_queries",
]


def load_all():
    """Import every query module (each registers itself) and return (queries, oracles)."""
    for name in _MODULES:
        importlib.import_module(name)
    from tickflow.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
