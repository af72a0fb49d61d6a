"""Activity per time bucket, bursts per user, and lateness against the publication window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from covspark.functions.dates import daily_window_at, market_clock
from covspark.operators import ordered
from covspark.streaming import sinks


def _watermarked(events: DataFrame, time: str, delay: str) -> DataFrame:
    # watermarks need an instant, not a timestamp without zone
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def per_bucket(
    events: DataFrame, time: str, width: str = "1 hour", by: str | None = None, delay: str | None = None
) -> DataFrame:
    """Rows per time bucket, for batch and streams alike."""
    if delay:
        events = _watermarked(events, time, delay)
    keys = [F.window(time, width), *([by] if by else [])]
    return (
        events.groupBy(*keys)
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("bucket_start"), *([by] if by else []), "events")
    )


def bursts(
    events: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str | None = None
) -> DataFrame:
    """Session windows: runs of a user's events with pauses below ``gap``.

    Rows behind the watermark are dropped and a user's rows of a batch share a task; see
    ``follow_bursts`` for a stream without either, and ``finished_bursts`` for a finished table.
    """
    if delay:
        events = _watermarked(events, time, delay)
    return (
        events.groupBy(F.session_window(time, gap), by)
        .agg(F.count("*").alias("events"))
        .select(
            by,
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "events",
        )
    )


def elapsed(unit: str, time: str):
    """Whole units since 1970, a number that never decreases along the time."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ'1970-01-01 00:00:00', {time})")


def finished_bursts(
    events: DataFrame, time: str, by: str, order: list[str], gap_seconds: int
) -> DataFrame:
    """Bursts of a finished table, cut per user and day and joined up."""
    timed = events.withColumn("_us", elapsed("MICROSECOND", time))
    runs = ordered.runs(
        timed,
        [by],
        order,
        elapsed("DAY", time),
        ["_us"],
        lambda previous, current: current["_us"] - previous["_us"] > gap_seconds * 1_000_000,
    )
    return (
        runs.groupBy(by, "run")
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events"))
        .drop("run")
    )


# Bursts of a stream are kept as cells: what a user did within one stretch of ``gap`` is one burst at any
# rate. A cell is a plain partial aggregate, so a busy user is reduced on every task, and cells of
# different batches, however late, just add up.


def cells(events: DataFrame, time: str, by: str, gap_seconds: int) -> DataFrame:
    """by, cell, first, last and number of events of every stretch of ``gap_seconds`` with some."""
    width = F.lit(gap_seconds * 1_000_000)
    timed = events.where(F.col(time).isNotNull()).withColumn("_us", elapsed("MICROSECOND", time))
    return timed.groupBy(by, F.floor(F.col("_us") / width).alias("cell")).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("events")
    )


def follow_bursts(
    events: DataFrame, time: str, by: str, gap_seconds: int, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Keep the cells of a stream in a table; the stream has no state of its own and drops no late row."""
    merge = {"first": F.min, "last": F.max, "events": F.sum}
    prepare = lambda batch: cells(batch, time, by, gap_seconds)
    return sinks.upsert_batches(events, path, checkpoint, [by, "cell"], prepare, merge, **trigger)


def bursts_of_cells(kept: DataFrame, by: str, gap_seconds: int) -> DataFrame:
    """Neighbouring cells joined where their pause is at most the gap, per user and day and then across days."""
    us = {c: elapsed("MICROSECOND", c).alias(f"_{c}") for c in ("first", "last")}
    runs = ordered.runs(
        kept.select("*", *us.values()),
        [by],
        ["cell"],
        F.floor(F.col("cell") * gap_seconds / 86_400),
        ["_first", "_last"],
        lambda previous, current: current["_first"] - previous["_last"] > gap_seconds * 1_000_000,
    )
    return (
        runs.groupBy(by, "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"))
        .drop("run")
    )


def read_bursts(spark: SparkSession, path: str, schema: T.StructType, by: str, gap_seconds: int) -> DataFrame:
    """The bursts so far; ``schema`` is that of ``cells``."""
    return bursts_of_cells(sinks.current(spark, path, schema), by, gap_seconds)


def arrival_class(rows: DataFrame, day: str, arrived_utc: str) -> DataFrame:
    """Adds ``arrival``: before, inside or after the publication window of the row's day."""
    return rows.withColumn(
        "arrival", daily_window_at(F.col(day), market_clock(F.col(arrived_utc)))
    )
