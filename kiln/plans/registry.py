"""Registry of the queries exposed through ``__spark_entry__``.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver
tables, optionally paired with an equivalent DuckDB SQL string (the oracle).
Queries without SQL get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Decorator registering a query under ``key`` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every ``q_*`` plan module so their decorators run."""
    import importlib
    import pkgutil

    import kiln.plans as pkg

    for mod in sorted(m.name for m in pkgutil.iter_modules(pkg.__path__)):
        if mod.startswith("q_"):
            importlib.import_module(f"kiln.plans.{mod}")
