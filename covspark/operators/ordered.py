"""Ordered computations that stay parallel inside one hot group.

A plain window puts a whole group on one task. Here the caller names ``bucket``, a
column that never decreases along the order (a day of a timestamp, a range of ids).
Each (group, bucket) is windowed on its own, one summary row per bucket carries the
state across, and the carried part is joined back. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_bucket(df: DataFrame, name: str, buckets: int = 64) -> Column:
    """A bucket for a numeric column, cut at sampled quantiles that become literals."""
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(name, probabilities, 1 / (2 * buckets))))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(cut) for cut in cuts]), lambda cut: cut <= F.col(name)))


def _carry(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    on = [rows[k].eqNullSafe(summary[k]) for k in [*keys, "_bucket"]]
    return rows.join(summary, on).drop(*[summary[k] for k in [*keys, "_bucket"]])


def position(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "position"
) -> DataFrame:
    """1-based position of every row inside its group."""
    rows = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    summary = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        _carry(rows.withColumn("_at", F.row_number().over(inside)), summary, keys)
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_before", "_at", "_bucket")
    )


def runs(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    value: list[str],
    breaks: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Number of the run each row belongs to, as ``run`` (1-based per group).

    A run ends where ``breaks(previous, current)`` holds for the ``value`` structs of
    neighbouring rows; by default where they differ.
    """
    breaks = breaks or (lambda previous, current: ~previous.eqNullSafe(current))

    def opens(previous: Column, current: Column, at_first: int) -> Column:
        return F.when(previous.isNull(), at_first).otherwise(breaks(previous, current).cast("int"))

    rows = df.withColumn("_bucket", bucket).withColumn("_value", F.struct(*value))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn("_last", F.lag("_value").over(inside)).withColumn(
        "_change", opens(F.col("_last"), F.col("_value"), 0)
    )
    at = F.struct(*order)
    along = Window.partitionBy(*keys).orderBy("_bucket")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = (
        rows.groupBy(*keys, "_bucket")
        .agg(
            F.sum("_change").alias("_changes"),
            F.min_by("_value", at).alias("_first"),
            F.max_by("_value", at).alias("_final"),
        )
        .withColumn("_border", F.lag("_final").over(along))
        .withColumn("_opens", opens(F.col("_border"), F.col("_first"), 1))
        .withColumn("_base", F.sum(F.col("_changes") + F.col("_opens")).over(so_far) - F.col("_changes"))
        .select(*keys, "_bucket", "_base")
    )
    local = F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        _carry(rows.withColumn("_local", local), summary, keys)
        .withColumn("run", F.col("_base") + F.col("_local"))
        .drop("_bucket", "_value", "_last", "_change", "_local", "_base")
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group, ranked as ``rank``.

    Spark ranks inside each task first and shuffles at most ``n`` rows of a group from it, as
    long as ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default) is not below n.
    """
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)
