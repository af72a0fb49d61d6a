"""Trading-calendar operators. A calendar has one row per exchange and civil date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covspark.operators.intervals import covered_days


def open_dates(
    calendar: DataFrame, time_range: tuple[date, date] | None = None, exchanges=None
) -> DataFrame:
    """Days on which any of the exchanges is open."""
    rows = calendar.where("is_open")
    if exchanges is not None:
        rows = rows.where(F.col("exchange").isin(list(exchanges)))
    if time_range is not None:
        rows = rows.where(
            (F.col("cal_date") >= F.lit(time_range[0])) & (F.col("cal_date") < F.lit(time_range[1]))
        )
    return rows.select("cal_date").distinct()


def open_dates_in(calendar: DataFrame, jobs: DataFrame, exchanges=None) -> DataFrame:
    """Open days inside at least one job interval (start, end)."""
    days = open_dates(calendar, exchanges=exchanges)
    wanted = covered_days(jobs).withColumnRenamed("day", "cal_date")
    return days.join(wanted, "cal_date", "left_semi")


def previous_open(calendar: DataFrame) -> DataFrame:
    """Derive each row's previous open date; an exchange has one row per civil date."""
    before = Window.partitionBy("exchange").orderBy("cal_date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return calendar.withColumn(
        "derived_pretrade_date",
        F.last(F.when(F.col("is_open"), F.col("cal_date")), ignorenulls=True).over(before),
    )


def pretrade_mismatches(calendar: DataFrame) -> DataFrame:
    """Rows whose supplied previous open date differs from the derived one."""
    return previous_open(calendar).where(
        F.col("derived_pretrade_date").isNotNull()
        & ~F.col("pretrade_date").eqNullSafe(F.col("derived_pretrade_date"))
    )
