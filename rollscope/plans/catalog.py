"""Registry of named queries (Spark plan builder + optional DuckDB oracle SQL)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the DuckDB oracle (omitted for operators with no SQL form)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Round doubles to 6 places on the Spark side (the oracle does the same)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    # importing the modules runs their @register decorators
    from . import q_class, q_boxes, q_text, q_prompts, q_tokens, q_io, q_stream, q_lists, q_large_boxes  # noqa: F401
