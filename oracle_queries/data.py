"""The driver's tables seen as datasets: contracts, facts, coverage, weights, jobs."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covspark.operators import coverage as cov
from covspark.spec import DatasetSpec, fields
from oracle_queries.registry import table

NOW = datetime(2024, 1, 20, 16, 0, tzinfo=ZoneInfo("Asia/Shanghai"))

EVENTS = DatasetSpec(
    "driver/events",
    fields("event_id long!, user_id long!, day date!, event_type string, value double"),
    primary_key=("event_id",),
    partition_key="user_id",
    time_field="day",
    policy="accept-empty",
    capabilities={"row_limit": 300},
)
# the same rows laid out by month: the time field belongs to the key
EVENT_DAYS = DatasetSpec(
    "driver/event_days",
    fields("user_id string!, day date!, event_id long!, event_type string, value double"),
    primary_key=("user_id", "day", "event_id"),
    partition_key="user_id",
    time_field="day",
    policy="accept-empty",
)
ORDERS = DatasetSpec(
    "driver/orders",
    fields(
        "o_orderkey long!, o_custkey long!, o_orderstatus string, o_totalprice double, "
        "o_orderdate date, o_orderpriority string"
    ),
    primary_key=("o_orderkey",),
    partition_key="o_custkey",
    time_field="o_orderdate",
)


def within(df: DataFrame, time: str, time_range) -> DataFrame:
    """The same half-open range on the raw timestamp, which the scan can use to skip."""
    start, end = (F.lit(str(side)).cast("timestamp_ntz") for side in time_range)
    return df.where((F.col(time) >= start) & (F.col(time) < end))


def events(spark: SparkSession, sf: str, time_range=None) -> DataFrame:
    raw = table(spark, sf, "events")
    return (raw if time_range is None else within(raw, "ts", time_range)).select(
        "event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value"
    )


def event_days(spark: SparkSession, sf: str, time_range=None) -> DataFrame:
    return events(spark, sf, time_range).select(
        F.col("user_id").cast("string").alias("user_id"), "day", "event_id", "event_type", "value"
    )


EVENTS_SQL = "SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type, value FROM events"


def orders(spark: SparkSession, sf: str, time_range=None) -> DataFrame:
    raw = table(spark, sf, "orders")
    return (raw if time_range is None else within(raw, "o_orderdate", time_range)).select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.to_date("o_orderdate").alias("o_orderdate"),
        "o_orderpriority",
    )


def hull(spark: SparkSession, sf: str, event_type: str | None = None) -> DataFrame:
    """First to last day of each user's events of one type, as coverage rows."""
    rows = events(spark, sf)
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    return cov.derive(rows, "user_id", "day")


def hull_sql(event_type: str | None = None) -> str:
    where = f"WHERE event_type = '{event_type}'" if event_type else ""
    return (
        'SELECT CAST(user_id AS VARCHAR) AS key, CAST(min(ts) AS DATE) AS start, '
        f'CAST(max(ts) AS DATE) + 1 AS "end" FROM events {where} GROUP BY user_id'
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").cast("string").alias("key")).distinct()


USERS_SQL = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events"


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as indexes, parts as constituents, ship dates as snapshot dates."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("trade_date"))
        .agg(F.max("l_quantity").alias("weight"))
        .select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("index_code"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("con_code"),
            "trade_date",
            "weight",
        )
    )


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """The same memberships straight from the rows; repeats do not matter to lookups."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("index_code"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("con_code"),
        F.to_date("l_shipdate").alias("trade_date"),
    )


WEIGHTS_SQL = (
    "SELECT 'S' || l_suppkey AS index_code, 'P' || l_partkey AS con_code, "
    "CAST(l_shipdate AS DATE) AS trade_date, max(l_quantity) AS weight "
    "FROM lineitem GROUP BY 1, 2, 3"
)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Two exchanges with a row per day of the event range: weekdays, and days with purchases."""
    rows = events(spark, sf)
    span = rows.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("cal_date"))
    bought = rows.where("event_type = 'purchase'").select(
        F.col("day").alias("cal_date"), F.lit(True).alias("busy")
    ).distinct()
    sse = days.select(
        F.lit("SSE").alias("exchange"), "cal_date", (F.weekday("cal_date") < 5).alias("is_open")
    )
    szse = days.join(bought, "cal_date", "left").select(
        F.lit("SZSE").alias("exchange"),
        "cal_date",
        (F.coalesce("busy", F.lit(False)) & (F.weekday("cal_date") < 4)).alias("is_open"),
    )
    return sse.union(szse)


CALENDAR_SQL = """
SELECT 'SSE' AS exchange, d AS cal_date, isodow(d) < 6 AS is_open FROM days
UNION ALL
SELECT 'SZSE', d, isodow(d) < 5 AND d IN
  (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'purchase') FROM days"""
DAYS_SQL = """
SELECT CAST(unnest(generate_series((SELECT CAST(min(ts) AS DATE) FROM events),
  (SELECT CAST(max(ts) AS DATE) FROM events), INTERVAL 1 DAY)) AS DATE) AS d"""
