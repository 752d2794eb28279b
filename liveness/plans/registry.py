"""Registry of checked queries: one per operator of the inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` plus, when the operator is
relational, an equivalent DuckDB SQL text over the same driver tables. Column names
and types are aligned on both sides; doubles that come out of sums/averages are
snapped with the same half-up expression on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def snap_sql(expr: str, digits: int = 4) -> str:
    """DuckDB twin of ``round_half_up``."""
    scale = float(10 ** digits)
    return f"(floor(({expr}) * {scale} + {0.5 + 1e-9!r}) / {scale})"


def load_all() -> None:
    """Import the modules that register queries."""
    from . import (q_catalogue, q_corpus, q_etl, q_files, q_history, q_io, q_model, q_results,  # noqa: F401
                   q_stream, q_text)
