"""The registered queries and their DuckDB SQL by name, and what both sides round alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwind.plans.sql import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return register


def r6(column: str) -> F.Column:
    """Rounded to six places, without a negative zero."""
    return (F.round(F.col(column).cast("double"), 6) + F.lit(0.0)).alias(column)


def r(column: str, name: str | None = None) -> str:
    """The same in SQL."""
    return f"round(CAST({column} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name or column}"
