"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Each query maps the driver tables onto the domain (``sources.tables``), then runs the
library operator over the whole tables. ``ORACLE_SQL`` holds the DuckDB statement that must
give the same rows; keys without SQL are checked on row counts only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Registers a query. A registered query asks for the runtime settings of the package
    (``session.configure``); the operators themselves leave the caller's session alone."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            return fn(configure(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    import importlib
    for name in ("q_ingest", "q_dims", "q_reads", "q_model", "q_forecasts", "q_stream"):
        try:
            importlib.import_module(f"{__package__}.{name}")
        except ModuleNotFoundError as e:
            if name not in str(e):
                raise
