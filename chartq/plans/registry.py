"""Registry of named queries (`queries()`) and their DuckDB oracle SQL (`oracle_sql()`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DOCS: dict[str, str] = {}


def register(key: str, sql: str | None = None, doc: str | None = None):
    """Register a query `(spark, sf_dir) -> DataFrame` and, when SQL-expressible, its oracle."""

    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        if doc is not None:
            DOCS[key] = doc
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that its registrations run."""
    from chartq.plans import q_eval, q_misc, q_profile, q_qa, q_rewards, q_sources, q_stream, q_table_oracle  # noqa: F401
