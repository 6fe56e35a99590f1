"""Registry of the queries that bind the operators to the fixture tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import rounded


@dataclass(frozen=True)
class Tables:
    """The parquet tables of one scale folder, read on access."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def lines(self) -> DataFrame:
        """Line items with the traits of their part."""
        return self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the fixture tables, with its DuckDB counterpart if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def out(df: DataFrame, keys: list, values: list[str], digits: int = 6) -> DataFrame:
    """Keys as they are, measures rounded."""
    return df.select(*keys, *[rounded(F.col(v), digits).alias(v) for v in values])


def mixo() -> Column:
    return F.col("p_type").isin("PROMO", "SMALL")


def auto() -> Column:
    return ~mixo()


def cyano() -> Column:
    return F.col("p_type") == "ECONOMY"
