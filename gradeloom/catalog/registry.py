from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def _plain_types(df: DataFrame) -> DataFrame:
    """Integers as bigint and other numbers as double, as the SQL side returns them."""
    def column(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            return c.cast("double").alias(field.name)
        return c
    return df.select(*(column(f) for f in df.schema.fields))


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` for the inventory rows ``ids``."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain_types(fn(spark, folder))

        QUERIES[name] = run
        INVENTORY[name] = ids
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return register
