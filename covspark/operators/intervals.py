"""Half-open date intervals per key: containment joins and interval algebra.

Containment joins carry an equality on (key, month), so they are ordinary hash or
sort-merge joins, a hot key is spread over its months, and AQE can split what stays
large. Interval unions go through per-date deltas, so a key never holds more than two
entries per civil date however many intervals it was given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covspark.functions.dates import month, month_starts


def in_scope_join(
    rows: DataFrame,
    scopes: DataFrame,
    key: str,
    time: str,
    how: str,
    extra: Column | None = None,
) -> DataFrame:
    """left_semi / left_anti of rows against scopes(key, start, end) by key and date.

    Rows with a null key or time match no scope.
    """
    cells = scopes.where("start < end").select(
        F.col("key").alias("_key"),
        F.col("start").alias("_start"),
        F.col("end").alias("_end"),
        *[F.col(c).alias(f"_{c}") for c in scopes.columns if c not in ("key", "start", "end")],
        F.explode(month_starts(F.col("start"), F.col("end"))).alias("_month"),
    )
    day = F.col(time)
    on = (
        (F.col(key) == F.col("_key"))
        & (month(day) == F.col("_month"))
        & (day >= F.col("_start"))
        & (day < F.col("_end"))
    )
    if extra is not None:
        on = on & extra
    return rows.join(cells, on, how)


def deltas(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Net number of intervals opening minus closing at each (key, date)."""
    edges = F.explode(
        F.array(
            F.struct(F.col("start").alias("day"), F.lit(1).alias("step")),
            F.struct(F.col("end").alias("day"), F.lit(-1).alias("step")),
        )
    )
    return (
        intervals.where("start < end")
        .select(*keys, edges.alias("_edge"))
        .groupBy(*keys, F.col("_edge.day").alias("day"))
        .agg(F.sum("_edge.step").alias("step"))
        .where("step != 0")
    )


def union(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint, non-touching intervals covering the same dates, in order per key."""
    per_key = deltas(intervals, keys).groupBy(*keys).agg(
        # at most one entry per civil date
        F.sort_array(F.collect_list(F.struct("day", "step"))).alias("_edges")
    )
    none = F.lit(None).cast("date")
    state = F.struct(
        F.lit(0).cast("bigint").alias("open"),
        none.alias("since"),
        F.array().cast("array<struct<start:date,end:date>>").alias("done"),
    )

    def step(acc, edge):
        now = acc["open"] + edge["step"]
        opens = (acc["open"] == 0) & (now > 0)
        closes = (acc["open"] > 0) & (now == 0)
        return F.struct(
            now.alias("open"),
            F.when(opens, edge["day"]).otherwise(acc["since"]).alias("since"),
            F.when(
                closes,
                F.concat(
                    acc["done"],
                    F.array(F.struct(acc["since"].alias("start"), edge["day"].alias("end"))),
                ),
            )
            .otherwise(acc["done"])
            .alias("done"),
        )

    return per_key.select(
        *keys, F.aggregate("_edges", state, step, lambda acc: acc["done"]).alias("intervals")
    )


def covered_days(intervals: DataFrame) -> DataFrame:
    """Days in any interval, by a running sum of deltas over the civil dates.

    The window runs over one row per distinct edge date, which the calendar bounds.
    """
    along = Window.orderBy("day")
    spans = (
        deltas(intervals, [])
        .withColumn("_open", F.sum("step").over(along))
        .withColumn("_until", F.lead("day").over(along))
        .where("_open > 0")
    )
    return spans.select(F.explode(F.sequence("day", F.date_sub("_until", 1))).alias("day"))
