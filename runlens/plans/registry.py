"""Pairs every ready-made query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query.

    ``columns`` lists the output as ``name`` (number, 4 decimals), ``name:2``
    (number, 2 decimals), ``name:d`` (number, not rounded: same arithmetic on
    single rows), ``name:i`` (count) or ``name:s`` (as it is).  The same list
    shapes the Spark result and the SQL result.
    """
    shape = [_shaped(c) for c in columns.split()]

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(spark, sf_dir).selectExpr(*shape)
        if sql is not None:
            SQL[name] = f"SELECT {', '.join(shape)} FROM (\n{sql.strip()}\n) AS q"
        return build

    return register


def _shaped(column: str) -> str:
    name, _, kind = column.partition(":")
    if kind == "s":
        return name
    if kind == "d":
        return f"CAST({name} AS DOUBLE) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    # adding zero turns a rounded -0.0 into 0.0 in both engines
    return f"round(CAST({name} AS DOUBLE), {kind or 4}) + 0e0 AS {name}"
