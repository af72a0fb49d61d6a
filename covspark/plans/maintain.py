"""The three maintenance operations as one lazy plan, from selectors to the table of requests.

``complete`` asks for what keeps coverage of a range without holes, ``refresh`` for a covered range
again, ``update`` for today. Each plan expands selectors to keys, cuts the range at the due boundary,
compares with coverage, takes the cheaper request shape and slices long ranges at the row limit.
Only the operands themselves, a few texts and two dates, are looked at on the driver; keys, jobs and
the choice of shape stay in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covspark.errors import OperandError
from covspark.functions import dates
from covspark.functions.selectors import parse_selector
from covspark.operators import calendar as cal
from covspark.operators import coverage as cov
from covspark.operators import members
from covspark.plans import work

COMPLETE, REFRESH, UPDATE = "complete", "refresh", "update"
ALL, STORED = "all", "stored"
# The exchanges whose calendars say which dates are open.
EXCHANGES = ("SSE", "SZSE")
_WORK = "shape string, key string, start date, end date"


@dataclass(frozen=True)
class Maintenance:
    """What an operation would request.

    ``requested`` is the due part of the range, None when nothing is due. ``jobs`` are the ranges per
    key, ``work`` the requests in the chosen shape, a market-wide one with a null key. ``problems``
    (subject, problem) must be empty before anything is fetched; ``missing`` are referenced indexes
    without a master row, work for the master dataset.
    """

    requested: tuple[date, date] | None
    symbols: DataFrame
    jobs: DataFrame
    work: DataFrame
    problems: DataFrame
    missing: DataFrame


def _texts(spark: SparkSession, selectors: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(selectors, DataFrame):
        return selectors.select("selector").distinct()
    return spark.createDataFrame([(s,) for s in dict.fromkeys(selectors)], "selector string")


def _said(column: str, value: str) -> Column:
    """``value`` in every row, but told from a column: a join on it stays an equality join."""
    return F.when(F.length(F.col(column).cast("string")) >= 0, value)


def due_range(
    operation: str, requested: tuple[date, date] | None, now: datetime, use_window: bool = True
) -> tuple[date, date] | None:
    """The due part of the operation's range; None for an update with nothing due."""
    today = dates.market_time(now).date()
    if operation == UPDATE:
        if requested is not None:
            raise OperandError("update takes no range")
        requested = (today, today + timedelta(days=1))
    if requested is None:
        raise OperandError(f"{operation} needs a range")
    start, end = requested[0], min(requested[1], work.due_end(now, use_window))
    if start < end:
        return start, end
    if operation == UPDATE:
        return None
    raise OperandError(f"{operation}: the range is before its publication window, nothing is due yet")


def plan(
    operation: str,
    selectors: Sequence[str] | DataFrame,
    requested: tuple[date, date] | None,
    now: datetime,
    coverage: DataFrame,
    calendar: DataFrame | None = None,
    weights: DataFrame | None = None,
    masters: DataFrame | None = None,
    row_limit: int | None = None,
    use_window: bool = True,
) -> Maintenance:
    """Selectors to requests. ``selectors`` are texts or a table of them (``selector``).

    ``all`` stands alone, for the whole market day by day; ``stored`` for every covered key. Without
    ``weights`` index selectors have no members; without a calendar that has every day of the range
    for each exchange, requests are per key. ``masters`` (ts_code) are the known indexes.
    """
    if operation not in (COMPLETE, REFRESH, UPDATE):
        raise OperandError(f"unsupported operation {operation!r}")
    spark = coverage.sparkSession
    named = [] if isinstance(selectors, DataFrame) else list(selectors)
    everything = ALL in named
    if everything and set(named) != {ALL}:
        raise OperandError("the selector 'all' must be used on its own")
    if everything and operation == REFRESH:
        raise OperandError("the selector 'all' is only for complete and update")
    due = due_range(operation, requested, now, use_window)
    texts = _texts(spark, selectors)
    if due is None:
        texts = texts.limit(0)
    today = dates.market_time(now).date()
    start, end = due or (today, today)

    parsed = texts.select("selector", parse_selector(F.col("selector")).alias("s"))
    problems = parsed.where((F.col("s.kind") == "invalid") | ((F.col("s.kind") == ALL) & F.lit(not everything))).select(
        F.col("selector").alias("subject"), F.lit("invalid selector").alias("problem")
    )
    indexes = parsed.where(F.col("s.kind") == "index").select(F.col("s.code").alias("ts_code")).distinct()
    missing = indexes.limit(0) if masters is None else work.missing_references(indexes, masters, "ts_code")
    problems = problems.unionByName(missing.select(F.col("ts_code").alias("subject"), F.lit("no master row").alias("problem")))

    # one row if the selector is there, so small whatever the coverage
    asks_stored = F.broadcast(texts.where(F.col("selector") == STORED).select(F.col("selector").alias("_stored")).limit(1))
    stored = coverage.select("key", _said("key", STORED).alias("_stored")).join(asks_stored, "_stored", "left_semi").select("key")
    if weights is None:
        direct = parsed.where(F.col("s.kind") == "security").select(F.col("s.code").alias("key"))
    else:
        requests = members.selector_requests(texts, (start, end))
        direct = members.expand_selectors(texts, weights, (start, end)).withColumnRenamed("symbol", "key")
        unresolved = members.problems(requests, weights)
        problems = problems.unionByName(unresolved.select(F.col("index_code").alias("subject"), F.col("status").alias("problem")))
    symbols = direct.union(stored).distinct()

    asked = symbols.select("key", F.lit(start).alias("start"), F.lit(end).alias("end"))
    if operation == REFRESH:
        jobs = asked
        beyond = cov.outside(asked, coverage)
        problems = problems.unionByName(beyond.select(F.col("key").alias("subject"), F.lit("outside coverage").alias("problem")))
    else:
        gaps = cov.continuity_gaps(asked, coverage)
        jobs = gaps.select("key", F.col("work_start").alias("start"), F.col("work_end").alias("end"))

    per_key = jobs
    if calendar is None:
        if everything:
            raise OperandError("the selector 'all' needs a calendar")
        requests = _sliced(per_key, row_limit, None)
        return Maintenance(due, symbols, jobs, requests, problems, missing)
    known = calendar.where(F.col("exchange").isin(*EXCHANGES))
    if everything:
        days = cal.open_dates(known, (start, end))
        return Maintenance(due, symbols, jobs, _market(days), problems.unionByName(_holes(known, start, end)), missing)
    return Maintenance(due, symbols, jobs, _shaped(jobs, known, row_limit), problems, missing)


def _sliced(jobs: DataFrame, row_limit: int | None, open_dates: DataFrame | None) -> DataFrame:
    pieces = work.sliced(jobs, row_limit, open_dates) if row_limit else jobs
    return pieces.select(F.lit(work.PER_KEY).alias("shape"), "key", "start", "end")


def _market(days: DataFrame) -> DataFrame:
    day = F.col("cal_date")
    return days.select(
        F.lit(work.MARKET).alias("shape"), F.lit(None).cast("string").alias("key"), day.alias("start"), F.date_add(day, 1).alias("end")
    )


def _holes(calendar: DataFrame, start: date, end: date) -> DataFrame:
    """Exchanges whose calendar doesn't have every day of the range."""
    have = calendar.where((F.col("cal_date") >= F.lit(start)) & (F.col("cal_date") < F.lit(end)))
    counts = have.groupBy(F.col("exchange").alias("subject")).agg(F.countDistinct("cal_date").alias("n"))
    wanted = calendar.sparkSession.createDataFrame([(x,) for x in EXCHANGES], "subject string")
    short = wanted.join(counts, "subject", "left").where(F.coalesce("n", F.lit(0)) < (end - start).days)
    return short.select("subject", F.lit("calendar incomplete").alias("problem"))


def _shaped(jobs: DataFrame, calendar: DataFrame, row_limit: int | None) -> DataFrame:
    """Requests per key or one a date for the whole market, whichever are strictly fewer.

    Market-wide requests need a calendar without holes between the first and the last day asked for.
    """
    days = cal.open_dates_in(calendar, jobs)
    tag = lambda df, name, *edges: df.select(F.lit(name).alias("what"), *(edges or [F.lit(None).cast("date").alias(c) for c in ("a", "b")]))
    each = calendar.select("exchange", "cal_date").distinct()
    wanted = tag(jobs, "job", F.col("start").alias("a"), F.col("end").alias("b")).unionByName(tag(days, "date"))
    counts = wanted.agg(
        F.count_if(F.col("what") == "job").alias("jobs"),
        F.count_if(F.col("what") == "date").alias("dates"),
        F.min("a").alias("a"),
        F.max("b").alias("b"),
    )
    # the one row meets the calendar's civil dates
    one = F.broadcast(counts.withColumn("_one", _said("jobs", "one")))
    complete = (
        each.withColumn("_one", _said("exchange", "one"))
        .join(one, "_one")
        .groupBy("jobs", "dates", "a", "b")
        .agg(F.count_if((F.col("cal_date") >= F.col("a")) & (F.col("cal_date") < F.col("b"))).alias("have"))
    )
    cheaper = (F.col("dates") > 0) & (F.col("dates") < F.col("jobs"))
    whole = F.col("have") == F.datediff("b", "a") * len(EXCHANGES)
    # without a calendar row there is no row here: per key is what then remains
    market = F.broadcast(complete.where(cheaper & whole).select(_said("jobs", work.MARKET).alias("_market")))
    marked = lambda df: df.withColumn("_market", _said("start", work.MARKET))
    per_key = marked(_sliced(jobs, row_limit, cal.open_dates(calendar))).join(market, "_market", "left_anti")
    return per_key.unionByName(marked(_market(days)).join(market, "_market", "left_semi")).drop("_market")
