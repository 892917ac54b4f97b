"""Tables of one data folder, and the registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

class Tables:
    """``t.nation`` reads nation.parquet; only the columns a query names are scanned."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def placed(self, df: DataFrame, key: str) -> DataFrame:
        """Coordinates derived from a key, from pole to pole, as the tables have none."""
        return df.withColumn("lat", F.expr(f"cast(({key} * 7919 % 180001) as double) / 1000.0D - 90")).withColumn("lon", F.expr(f"cast(({key} * 104729 % 360000) as double) / 1000.0D - 180"))

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small configured table, such as a rule list."""
        return self.spark.createDataFrame(rows, schema)


def placed_sql(table: str, key: str) -> str:
    """The same coordinates in DuckDB."""
    return f"(SELECT *, CAST({key} * 7919 % 180001 AS DOUBLE) / 1000.0 - 90 AS lat, CAST({key} * 104729 % 360000 AS DOUBLE) / 1000.0 - 180 AS lon FROM {table})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under a name, with its DuckDB counterpart."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep
