"""Queries over the driver's tables, each next to the SQL that must give the same rows.

Dates and timestamps leave as ISO text, so both engines compare on the same type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def as_text(df: DataFrame) -> DataFrame:
    def text(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return c.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        return c

    return df.select(*[text(f) for f in df.schema])


def register(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_text(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
