"""Named queries over the test tables, each with its SQL oracle."""

from __future__ import annotations

import importlib

from sluice.plans.registry import ORACLES, QUERIES, Query

MODULES = ("history", "flows", "measures", "texts", "products", "views", "golden", "atlas")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every module of queries and return queries and oracles by name."""
    for name in MODULES:
        importlib.import_module(f"sluice.plans.{name}")
    return dict(QUERIES), dict(ORACLES)
