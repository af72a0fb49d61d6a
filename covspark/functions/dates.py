"""Date, month and publication-window expressions. Every range is half-open."""

from __future__ import annotations

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The provider's market zone and its daily publication hours.
MARKET_ZONE = "Asia/Shanghai"
OPENS_HOUR = 15
CLOSES_HOUR = 17
BEFORE, INSIDE, AFTER = "before-window", "inside-window", "after-window"

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def iso_date(c: Column, today: date | None = None) -> Column:
    """A ten-character ISO date, or ``today`` when allowed; anything else is null."""
    parsed = F.when(c.rlike(ISO_DATE), c.try_cast("date"))
    return parsed if today is None else F.when(c == "today", F.lit(today)).otherwise(parsed)


def parse_ranges(df: DataFrame, name: str, today: date) -> DataFrame:
    """Adds start, end and status for ``start:end`` text; status is null when valid."""
    staged = (
        df.withColumn("_sides", F.split(name, ":", -1))
        .withColumn("_ok", F.coalesce(F.size("_sides") == 2, F.lit(False)))
        .withColumns({f"_{i}": F.when(F.col("_ok"), F.get("_sides", F.lit(i))) for i in (0, 1)})
        .withColumns({f"_day{i}": iso_date(F.col(f"_{i}"), today) for i in (0, 1)})
        .withColumn(
            "status",
            F.when(~F.col("_ok"), "not start:end")
            .when(F.col("_day0").isNull() | F.col("_day1").isNull(), "invalid date")
            .when(F.col("_day0") >= F.col("_day1"), "empty or reversed"),
        )
    )
    valid = F.col("status").isNull()
    return staged.select(
        *df.columns,
        F.when(valid, F.col("_day0")).alias("start"),
        F.when(valid, F.col("_day1")).alias("end"),
        "status",
    )


def month(c: Column) -> Column:
    return F.trunc(c, "MM")


def next_month(c: Column) -> Column:
    return F.add_months(month(c), 1)


def previous_month(c: Column) -> Column:
    return F.add_months(month(c), -1)


def expand_to_months(start: Column, end: Column) -> tuple[Column, Column]:
    """The whole months a range touches."""
    return month(start), next_month(F.date_sub(end, 1))


def month_starts(start: Column, end: Column) -> Column:
    """First days of the months a non-empty range touches, in order."""
    return F.sequence(month(start), month(F.date_sub(end, 1)), F.expr("interval 1 month"))


def days(start: Column, end: Column) -> Column:
    return F.when(start < end, F.sequence(start, F.date_sub(end, 1))).otherwise(
        F.array().cast("array<date>")
    )


def is_weekday(c: Column) -> Column:
    return F.weekday(c) < 5


def weekdays(start: Column, end: Column) -> Column:
    return F.filter(days(start, end), is_weekday)


def provider_inclusive(start: Column, end: Column) -> tuple[Column, Column]:
    """First and last day of a range as the provider's ``YYYYMMDD`` text."""
    return F.date_format(start, "yyyyMMdd"), F.date_format(F.date_sub(end, 1), "yyyyMMdd")


def format_range(start: Column, end: Column) -> Column:
    return F.concat_ws(":", start.cast("string"), end.cast("string"))


def market_time(now: datetime) -> datetime:
    """``now`` on the market's clock. Naive times are refused."""
    if now.tzinfo is None:
        raise ValueError("publication windows need a timezone-aware time")
    return now.astimezone(ZoneInfo(MARKET_ZONE)).replace(tzinfo=None)


def market_clock(utc: Column) -> Column:
    """A UTC timestamp-without-zone column on the market's clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), utc)


def _window(target: Column, today: Column, hour: Column) -> Column:
    return (
        F.when(target < today, AFTER)
        .when(target > today, BEFORE)
        .when(hour < OPENS_HOUR, BEFORE)
        .when(hour < CLOSES_HOUR, INSIDE)
        .when(target.isNotNull() & today.isNotNull(), AFTER)
    )


def daily_window(target: Column, now: datetime) -> Column:
    """Publication window of each target day at one instant."""
    local = market_time(now)
    return _window(target, F.lit(local.date()), F.lit(local.hour))


def daily_window_at(target: Column, clock: Column) -> Column:
    """Publication window of each target day at a per-row market time."""
    return _window(target, clock.cast("date"), F.hour(clock))


def monthly_window(target: Column, now: datetime) -> Column:
    current = F.lit(market_time(now).date().replace(day=1))
    return (
        F.when(month(target) < current, AFTER)
        .when(month(target) > current, BEFORE)
        .when(target.isNotNull(), INSIDE)
    )


def latest_due(now: datetime) -> date:
    """Last day whose publication window has at least opened."""
    local = market_time(now)
    return local.date() if local.hour >= OPENS_HOUR else date.fromordinal(
        local.date().toordinal() - 1
    )
