"""The register of named queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from draftlens.sources.derive import duckdb_text
from draftlens.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = ""):
    """Register a query; ``tables`` names the derived tables its SQL reads."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql)
        return fn

    return wrap


def with_tables(names: str, body: str) -> str:
    """A statement whose derived tables are spelled out in front."""
    ctes = [f"{n} AS ({duckdb_text(n)})" for n in names.split()]
    body = body.strip()
    if not ctes:
        return body
    head = "WITH RECURSIVE" if body.upper().startswith("WITH RECURSIVE") else "WITH"
    if body.upper().startswith("WITH"):
        body = body[len(head):].strip()
        return f"{head} {', '.join(ctes)}, {body}"
    return f"{head} {', '.join(ctes)} {body}"


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
