"""Registration of operators and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The Parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Registry:
    """Collects operators; each gets the SQL that defines its result, where SQL can state it."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def operator(self, sql: str | None = None):
        def put(build: Callable[[Tables], DataFrame]):
            name = build.__name__
            self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
            if sql is not None:
                self.oracles[name] = sql
            return build

        return put
