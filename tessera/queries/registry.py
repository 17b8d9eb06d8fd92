from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """``covers`` names the operators of the inventory that it shows."""

    build: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(covers: str, sql: str | None = None, doubles: str = ""):
    """Register ``f(tables)`` under its name. ``doubles`` names columns that the
    SQL computes as decimals."""
    if sql and doubles:
        sql = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in doubles.split())}) from ({sql})"

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = Query(lambda spark, folder: f(Tables(spark, folder)), covers, sql)
        return f

    return register
