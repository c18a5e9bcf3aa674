"""Registry of named queries: a Spark builder and (when SQL-expressible) a
DuckDB oracle string with identical column names and types.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole fixture tables.  Modules add entries with :func:`register`.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from netwarden.plans import q_sources, q_clean, q_rules, q_search, q_dashboard, q_metrics  # noqa: F401
    from netwarden.plans import q_sampling, q_features, q_models, q_persist, q_streams  # noqa: F401
