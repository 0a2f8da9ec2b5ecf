"""Where queries and their oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contract.adapter import ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, blocks: tuple[str, ...] = (), extra: str = "", casts: str = ""):
    """Register a query; ``oracle`` is its DuckDB SELECT over ``blocks`` and the CTE list ``extra``.

    ``casts`` like ``"a INT, b DOUBLE"`` gives result columns the type Spark has for them.
    """

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            parts = [p for p in (ctes(*blocks) if blocks else "", extra.strip().rstrip(",")) if p]
            select = oracle.strip()
            if casts:
                typed = ", ".join("CAST({0} AS {1}) AS {0}".format(*c.split()) for c in casts.split(","))
                select = f"SELECT * REPLACE ({typed}) FROM ({select})"
            ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + select
        return function

    return register
