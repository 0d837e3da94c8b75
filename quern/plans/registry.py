"""The queries by name, each with the SQL that a second engine checks it by, if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes; literal tables by ``values``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def values(self, literal: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {literal}")


def query(name: str, oracle: str | None = None):
    """Register a function of Tables under a name."""

    def put(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return f

    return put
