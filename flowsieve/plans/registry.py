"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame``, with its SQL twin where SQL can say it."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def st(expr: str) -> str:
    """SQL twin of ``functions.columns.stable``."""
    return f"CAST(CAST(round(CAST({expr} AS DOUBLE), 9) + 0.0 AS FLOAT) AS DOUBLE)"


def sts(*pairs: str) -> str:
    """``st`` over several ``expr AS name`` items."""
    out = []
    for p in pairs:
        expr, name = p.rsplit(" AS ", 1)
        out.append(f"{st(expr)} AS {name}")
    return ", ".join(out)
