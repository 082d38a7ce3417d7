"""Where the plans of the frame engine register their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starloom.sources.frames import PX_SQL, pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def on_px(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    query(name, f"WITH {PX_SQL} {sql}" if sql else None)(lambda s, d: f(pixels(s, d)))
