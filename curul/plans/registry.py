"""Named queries over the driver tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curul.session import tune
from curul.sources.staging import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its check."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if check:
            CHECKS[fn.__name__] = with_views(check)
        return fn

    return register


def sql_norm(expression: str) -> str:
    """Comparison form of a text in the checks' SQL."""
    bare = f"translate({expression}, '^`¨¯´·¸', '')"
    return f"trim(regexp_replace(lower(strip_accents({bare})), '\\s+', ' ', 'g'))"
