"""Named queries over the driver's tables, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL over the tables and the adapters' views."""

    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = with_views(sql)
        return function

    return keep


def rounded(column: Column | str, places: int = 6) -> Column:
    """Floating sums depend on their order; results are compared to ``places`` decimals."""
    return F.round(column, places)
