"""The core's registered queries by subject, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict):
    """name -> (query, SQL or None)."""

    def add(self, sql: str | None = None, *tables: str):
        """Register a function of the named tables under its own name."""

        def register(f):
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(*(table(spark, sf_dir, t) for t in tables))

            query.__name__, query.__doc__ = f.__name__, f.__doc__
            self[f.__name__] = (query, sql)
            return f

        return register
