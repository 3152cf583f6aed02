"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import share_code


class Tables:
    """The tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registrar(queries: dict, oracles: dict) -> Callable:
    def query(sql: str | None = None):
        def add(function: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, folder: str) -> DataFrame:
                share_code(spark)
                return function(Tables(spark, folder))

            queries[function.__name__] = run
            if sql:
                oracles[function.__name__] = sql
            return function

        return add

    return query
