"""Collects queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slopewise.sources import street_network

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, network: bool = True) -> Callable[[Query], Query]:
    """Registers a query; sql may use the tables of the derived network, unless network is false."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            if network:
                recursive = "RECURSIVE " if "USING KEY" in body else ""
                body = f"WITH {recursive}{street_network.SQL}" + (f", {body[5:]}" if body.startswith("WITH ") else f" {body}")
            ORACLE_SQL[name] = body
        return f

    return register
