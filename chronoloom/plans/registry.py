"""All named queries, and the SQL that checks them."""

from __future__ import annotations

import importlib

from chronoloom.plans.catalog import ORACLES, QUERIES, Query

MODULES = ("panel", "metrics", "cleaning", "relations", "forecast", "streaming", "sources")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"chronoloom.plans.queries_{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
