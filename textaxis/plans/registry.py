"""A registry of queries: a name, a function of (spark, sf_dir), and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries and their SQL, in order of registration."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a function of ``t``, which reads a table of the data folder by name."""

        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add
