"""The registered queries: each operator over whole tables, with the same in plain SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["validation", "columns", "analytics", "audit", "splits", "scoring", "comparison", "training"]


def entries() -> dict:
    """``name -> (callable(spark, folder), sql or None)``."""
    found = {}
    for module in MODULES:
        found.update(import_module(f"textlab.catalog.{module}").QUERIES)
    return found
