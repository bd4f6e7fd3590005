"""Queries of the engine's own operators and their SQL twins, by name."""

from __future__ import annotations

MODULES = ("operators.facets", "operators.joins", "operators.aggregates", "operators.graph", "operators.labels", "operators.pages", "operators.learning", "operators.resolution", "operators.search", "operators.locate", "operators.topology", "operators.surface", "operators.workflow", "operators.roundtrips", "streaming.windows")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function, with the SQL that must agree with it."""

    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"claimloom.{module}")
