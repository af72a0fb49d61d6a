"""Point-in-time membership. The snapshot's ``trade_date`` decides, so nothing looks ahead.

As-of lookups run over distinct (index, date) points. An index has at most one point per
civil date, so its window stays small however many rows or requests it has; the answers
join back by equality.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covspark.functions.dates import month, month_starts, next_month, previous_month
from covspark.functions.selectors import PREFIX, parse_selector

LATEST, RANGE_UNION = "latest", "range_union"


def latest_in_month(
    df: DataFrame, index: str = "index_code", day: str = "trade_date", bucket: str = "effective_month"
) -> DataFrame:
    """Bucket rows by month and keep those of the latest date in their (index, month).

    Groups hold one month of one index, which the calendar and the index bound.
    """
    dated = df.withColumn(bucket, month(F.col(day)))
    newest = F.max(day).over(Window.partitionBy(index, bucket))
    kept = dated.withColumn("_newest", newest).where(F.col(day) == F.col("_newest"))
    order = [index, bucket, *[c for c in df.columns if c not in (index, bucket)]]
    return kept.select(*order)


# order of equal dates: lookups strictly before a day, the snapshot, lookups up to the day
_BEFORE, _SNAPSHOT, _UP_TO = 0, 1, 2


def _look_up(points: DataFrame, weights: DataFrame) -> DataFrame:
    """Fill ``snapshot`` of distinct lookup points (index_code, day, turn)."""
    both = (
        points.union(weights.select("index_code", "trade_date", F.lit(_SNAPSHOT)))
        .where("index_code is not null and day is not null")
        .distinct()
    )
    so_far = Window.partitionBy("index_code").orderBy("day", "turn").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    given = F.when(F.col("turn") == _SNAPSHOT, F.col("day"))
    return both.withColumn("snapshot", F.max(given).over(so_far)).where(
        F.col("turn") != _SNAPSHOT
    )


def as_of(rows: DataFrame, weights: DataFrame, index: str, day: str) -> DataFrame:
    """Adds ``snapshot``, the date in force for each row's index and day."""
    points = rows.select(
        F.col(index).alias("index_code"), F.col(day).alias("day"), F.lit(_UP_TO).alias("turn")
    )
    found = _look_up(points, weights).select(
        F.col("index_code").alias(index), F.col("day").alias(day), "snapshot"
    )
    return rows.join(found, [index, day], "left")


_REQUEST = ["index_code", "start", "end", "selection"]


def answers(requests: DataFrame, weights: DataFrame) -> DataFrame:
    """Distinct requests with ``last`` (latest before end), ``first`` (in force at start)
    and ``status``, which is null when the request can be answered."""
    wanted = requests.select(*_REQUEST).distinct()
    sides = F.explode(
        F.array(
            F.struct(F.col("start").alias("day"), F.lit(_UP_TO).alias("turn")),
            F.struct(F.col("end").alias("day"), F.lit(_BEFORE).alias("turn")),
        )
    )
    asked = wanted.select(*_REQUEST, sides.alias("at")).select(
        *_REQUEST, F.col("at.day").alias("day"), F.col("at.turn").alias("turn")
    )
    found = _look_up(asked.select("index_code", "day", "turn"), weights)
    return (
        asked.join(found, ["index_code", "day", "turn"], "left")
        .groupBy(*_REQUEST)
        .agg(
            F.max(F.when(F.col("turn") == _UP_TO, F.col("snapshot"))).alias("first"),
            F.max(F.when(F.col("turn") == _BEFORE, F.col("snapshot"))).alias("last"),
        )
        .withColumn(
            "status",
            F.when(F.col("last").isNull(), "no snapshot before end").when(
                (F.col("selection") != LATEST) & F.col("first").isNull(),
                "no snapshot on or before start",
            ),
        )
    )


def resolve(requests: DataFrame, weights: DataFrame, member: str = "con_code") -> DataFrame:
    """(index_code, start, end, selection, symbol): distinct members of every request.

    ``latest`` takes the greatest snapshot before the end. ``range_union`` takes the one
    in force at the start and every later one before the end. Requests that cannot be
    answered yield no rows; see ``problems``.
    """
    is_latest = F.col("selection") == LATEST
    one = F.when(is_latest, F.col("last")).otherwise(F.col("first"))
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    spans = F.array(
        span(one, F.date_add(one, 1)),
        span(F.when(~is_latest, F.date_add("start", 1)), F.when(~is_latest, F.col("end"))),
    )
    picks = (
        answers(requests, weights)
        .where("status is null")
        .select(*_REQUEST, F.explode(spans).alias("_span"))
        .select(*_REQUEST, F.col("_span.low").alias("_low"), F.col("_span.high").alias("_high"))
        .where("_low < _high")
        .withColumn("_month", F.explode(month_starts(F.col("_low"), F.col("_high"))))
    )
    rows = weights.select(
        "index_code",
        "trade_date",
        F.col(member).alias("symbol"),
        month(F.col("trade_date")).alias("_month"),
    )
    return (
        picks.join(rows, ["index_code", "_month"])
        .where("trade_date >= _low and trade_date < _high")
        .select(*_REQUEST, "symbol")
        .distinct()
    )


def problems(requests: DataFrame, weights: DataFrame) -> DataFrame:
    return answers(requests, weights).where("status is not null").select(*_REQUEST, "status")


def in_range(weights: DataFrame, requests: DataFrame, member: str = "con_code") -> DataFrame:
    """Members without effective dating: any row of the key inside the range."""
    from covspark.operators.intervals import in_scope_join

    scopes = requests.select(F.col("index_code").alias("key"), "start", "end")
    return (
        in_scope_join(weights, scopes, "index_code", "trade_date", "left_semi")
        .select("index_code", F.col(member).alias("symbol"))
        .distinct()
    )


def selector_requests(
    selectors: DataFrame, requested: tuple[date, date], prefix: str = PREFIX
) -> DataFrame:
    """Index selectors as one membership request per index.

    A bare reference asks for the whole requested range, ``@latest`` for its last day and
    ``@YYYYMM`` for that month. Several selectors of one index merge to their hull, and a
    bare one makes the whole request a range union.
    """
    start, end = requested
    parsed = selectors.select(parse_selector(F.col("selector"), prefix).alias("s")).where(
        F.col("s.kind") == "index"
    )
    selection = F.col("s.selection")
    first = F.when(
        ~selection.isin("range", "latest"),
        F.try_to_date(F.concat(selection, F.lit("01")), "yyyyMMdd"),
    )
    begin = (
        F.when(selection == "range", F.lit(start))
        .when(selection == "latest", F.lit(end - timedelta(days=1)))
        .otherwise(first)
    )
    until = F.when(selection.isin("range", "latest"), F.lit(end)).otherwise(next_month(first))
    return (
        parsed.select(
            F.col("s.code").alias("index_code"),
            begin.alias("start"),
            until.alias("end"),
            (selection == "range").alias("bare"),
        )
        .groupBy("index_code")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.when(F.bool_or("bare"), RANGE_UNION).otherwise(LATEST).alias("selection"),
        )
    )


def expand_selectors(
    selectors: DataFrame,
    weights: DataFrame,
    requested: tuple[date, date],
    prefix: str = PREFIX,
) -> DataFrame:
    """Direct securities and the members of all index selectors, each symbol once."""
    direct = selectors.select(parse_selector(F.col("selector"), prefix).alias("s")).where(
        F.col("s.kind") == "security"
    )
    found = resolve(selector_requests(selectors, requested, prefix), weights)
    return direct.select(F.col("s.code").alias("symbol")).union(found.select("symbol")).distinct()


def fetch_window(start: Column, end: Column) -> tuple[Column, Column]:
    """Membership dates needed for a range: previous month up to the end of its last month."""
    return previous_month(start), next_month(F.date_sub(end, 1))


def first_seen(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return df.groupBy(value).agg(F.min(position).alias("first_position"))
