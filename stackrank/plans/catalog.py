"""Registry of named queries and their DuckDB oracle SQL.

``@query(name, oracle=SQL)`` registers a callable ``(spark, sf_dir) -> DataFrame``.
Queries without an oracle (model-based, randomised) are checked on rows and by
property tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all_queries() -> None:
    """Import every module that registers queries."""
    from stackrank.plans import (core_queries, feature_queries, route_queries,  # noqa: F401
                                 report_queries, model_queries, forest_queries,
                                 trial_queries, audit_queries)
