"""Collects the query and oracle dictionaries that each plan module declares."""

from __future__ import annotations

import importlib
import pkgutil

from catalith import plans


def _modules():
    for info in sorted(pkgutil.iter_modules(plans.__path__), key=lambda i: i.name):
        yield importlib.import_module(f"catalith.plans.{info.name}")


def queries() -> dict:
    """Every catalogue query: name -> callable(spark, sf_dir) -> DataFrame."""
    found: dict = {}
    for module in _modules():
        found |= getattr(module, "QUERIES", {})
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the catalogue queries that SQL can express."""
    found: dict[str, str] = {}
    for module in _modules():
        found |= getattr(module, "ORACLES", {})
    return found
