"""Event log as streams: unread events while acknowledgements arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from covspark.streaming import sinks

COLUMNS = "event_id string, severity string, acknowledged boolean"


def with_acknowledgements(
    events: DataFrame, acks: DataFrame, within: str, delay: str = "1 hour"
) -> DataFrame:
    """events(event_id, ts, …) left-joined with acks(reference, acked_at).

    A row comes out once its acknowledgement arrives, or unacknowledged when the watermark
    shows that none can come ``within`` that time any more; a later one isn't seen.
    """
    left = events.withWatermark("ts", delay)
    right = acks.withWatermark("acked_at", delay)
    on = (
        (F.col("event_id") == F.col("reference"))
        & (F.col("acked_at") >= F.col("ts"))
        & (F.col("acked_at") <= F.col("ts") + F.expr(f"interval {within}"))
    )
    return left.join(right, on, "left_outer").withColumn(
        "acknowledged", F.col("reference").isNotNull()
    )


def read_state(log: DataFrame) -> DataFrame:
    """State per event id without a time bound, of a table or of a stream in ``update`` mode.

    An event brings its severity and an acknowledgement its mark, in either order; unread
    are the ids with a severity and no mark.
    """
    is_ack = F.col("kind") == "acknowledgement"
    return (
        log.groupBy(F.when(is_ack, F.col("reference")).otherwise(F.col("event_id")).alias("event_id"))
        .agg(
            F.max(F.when(~is_ack, F.col("severity"))).alias("severity"),
            F.bool_or(is_ack).alias("acknowledged"),
        )
    )


def follow(log: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the state of every event in a table; the stream has no state of its own."""
    merge = {"severity": F.max, "acknowledged": F.bool_or}
    return sinks.upsert_batches(log, path, checkpoint, ["event_id"], read_state, merge, **trigger)


def unread(spark, path: str) -> DataFrame:
    """event_id and severity of the events nobody has acknowledged so far."""
    state = sinks.current(spark, path, StructType.fromDDL(COLUMNS))
    return state.where("severity IS NOT NULL AND NOT acknowledged").select("event_id", "severity")
