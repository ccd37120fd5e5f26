"""Registered queries and the DuckDB SQL that they are checked against."""

from __future__ import annotations

from faultline.plans import content_queries, factor_queries, failure_queries, io_queries, model_queries
from faultline.plans.failure_queries import flagship

MODULES = (failure_queries, content_queries, factor_queries, io_queries, model_queries)

__all__ = ["flagship", "oracles", "queries"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
