"""Running coverage per key over a stream of dated facts.

Each key keeps its first and last day and one bitmap of the days seen, all as ordinary
partial aggregates: a hot key is reduced on every task before it reaches its row in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from covspark.streaming import sinks

COLUMNS = "key string, bucket bigint, start date, last date, days binary"


def track(facts: DataFrame, key: str, day: str) -> DataFrame:
    """A row per key and bitmap bucket, of a table or of a stream in ``update`` mode."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("bigint")
    return (
        facts.where(F.col(key).isNotNull() & F.col(day).isNotNull())
        .groupBy(
            F.col(key).cast("string").alias("key"), F.bitmap_bucket_number(number).alias("bucket")
        )
        .agg(
            F.min(day).alias("start"),
            F.max(day).alias("last"),
            F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("days"),
        )
    )


def hulls(state: DataFrame) -> DataFrame:
    """(key, start, end, days, has_gap) from the tracked rows."""
    return (
        state.groupBy("key")
        .agg(
            F.min("start").alias("start"),
            F.date_add(F.max("last"), 1).alias("end"),
            F.sum(F.bitmap_count("days")).alias("days"),
        )
        .withColumn("has_gap", F.datediff("end", "start") != F.col("days"))
    )


def follow(facts: DataFrame, key: str, day: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the tracked rows of a stream of facts in a table; the stream has no state of its own."""
    merge = {"start": F.min, "last": F.max, "days": F.bitmap_or_agg}
    return sinks.upsert_batches(
        facts, path, checkpoint, ["key", "bucket"], lambda batch: track(batch, key, day), merge, **trigger
    )


def read(spark, path: str) -> DataFrame:
    return hulls(sinks.current(spark, path, StructType.fromDDL(COLUMNS)))
