"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (or data Spark derives from them). Oracle SQL reads the same
parquet tables through DuckDB views of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder (and its oracle SQL, when SQL can express it)."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_scoring,
        q_parsing,
        q_prompts,
        q_runs,
        q_datasets,
        q_cells,
        q_evidence,
        q_io,
        q_streaming,
    )
