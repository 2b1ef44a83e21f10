"""Registered queries on the given tables, each with the SQL it must agree with."""

import importlib

from panelcast.queries.registry import QUERIES

_MODULES = (
    "panel", "cleaning", "features", "splits", "explore", "evaluation", "capacity", "lags", "storage", "models",
)

for _m in _MODULES:
    importlib.import_module(f"panelcast.queries.{_m}")

__all__ = ["QUERIES"]
