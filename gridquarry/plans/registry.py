"""Queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def with_bigint_counts(sql: str) -> str:
    """DuckDB's count_if gives HUGEINT; Spark's gives BIGINT."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out += [sql[at:start], f"CAST({sql[start:end]} AS BIGINT)"]
        at = end
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_bigint_counts(sql)
        return f

    return add
