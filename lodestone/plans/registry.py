"""All registered queries and their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ("text_queries", "split_queries", "candidate_queries", "lexical_queries", "dense_queries", "routing_queries", "ranking_queries", "eda_queries", "ml_queries", "pipeline_queries", "preparation_queries", "feature_queries")


def query(name: str, sql: str | None = None):
    """Register a query callable (spark, sf_dir) -> DataFrame under `name`, with its SQL where one exists."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"lodestone.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
