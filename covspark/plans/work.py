"""Work tables: due dates, request shape, months to fetch, empty-result rules, dry runs."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.functions import dates
from covspark.operators import coverage as cov

MARKET, PER_KEY = "market", "per-key"
RESOLVED, UNRESOLVED, FAILURE, NO_PROMISE = "resolved", "unresolved", "failure", "no promise"


def due_end(now: datetime, use_window: bool = True) -> date:
    """First day that is not due yet. Without the window, today counts as due at once."""
    latest = dates.latest_due(now) if use_window else dates.market_time(now).date()
    return latest + timedelta(days=1)


def clamp_due(requests: DataFrame, now: datetime, use_window: bool = True) -> DataFrame:
    """Cut request ends at the due boundary; ``status`` says clamped, due or not due."""
    limit = F.lit(due_end(now, use_window))
    end = F.least("end", limit)
    return (
        requests.withColumn("due_end", F.when(F.col("start") < end, end))
        .withColumn(
            "status",
            F.when(F.col("due_end").isNull(), "not due")
            .when(F.col("due_end") < F.col("end"), "clamped")
            .otherwise("due"),
        )
    )


def stored_or_explicit(explicit: DataFrame, coverage: DataFrame) -> DataFrame:
    """Selector ``stored`` stands for every key that coverage already has."""
    named = explicit.where("key != 'stored'").select("key")
    if explicit.where("key = 'stored'").isEmpty():
        return named.distinct()
    return named.union(coverage.select("key")).distinct()


def shape_counts(jobs: DataFrame, open_dates: DataFrame) -> DataFrame:
    """One row: per-key requests, market-wide requests and the cheaper shape.

    Market-wide wins only when it needs strictly fewer requests and at least one.
    """
    both = jobs.select(F.lit(1).alias("j"), F.lit(0).alias("d")).union(
        open_dates.select(F.lit(0), F.lit(1))
    )
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(count("j").alias("key_requests"), count("d").alias("market_requests")).withColumn(
        "shape",
        F.when(
            (F.col("market_requests") > 0) & (F.col("market_requests") < F.col("key_requests")),
            MARKET,
        ).otherwise(PER_KEY),
    )


def choose_shape(
    jobs: DataFrame, open_dates: DataFrame | None
) -> tuple[str, DataFrame]:
    """The shape and its work table (key, start, end); a market request has a null key.

    ``open_dates`` is None when the calendar does not cover the jobs.
    """
    per_key = jobs.select("key", "start", "end")
    if open_dates is None:
        return PER_KEY, per_key
    shape = shape_counts(jobs, open_dates).first()["shape"]
    if shape == PER_KEY:
        return shape, per_key
    return shape, open_dates.select(
        F.lit(None).cast("string").alias("key"),
        F.col("cal_date").alias("start"),
        F.date_add("cal_date", 1).alias("end"),
    )


def classify_empty(policy: Column | str, window: Column, rows: Column) -> Column:
    """What an answer without rows means; null when there are rows."""
    policy = F.lit(policy) if isinstance(policy, str) else policy
    return F.when(
        rows == 0,
        F.when(policy == "strict", FAILURE)
        .when(policy == "best-effort", NO_PROMISE)
        .when(window == dates.AFTER, RESOLVED)
        .otherwise(UNRESOLVED),
    )


def index_months(requests: DataFrame, coverage: DataFrame, now: datetime) -> DataFrame:
    """(key, month, window): missing months and the current one, which can still change.

    A month before its window cannot be fetched; ``window`` shows it.
    """
    start, end = dates.expand_to_months(F.col("start"), F.col("end"))
    whole = requests.select("key", start.alias("start"), end.alias("end"))
    missing = cov.continuity_gaps(whole, coverage).select(
        "key", F.explode(dates.month_starts(F.col("work_start"), F.col("work_end"))).alias("month")
    )
    current = dates.market_time(now).date().replace(day=1)
    again = whole.where(
        (F.col("start") <= F.lit(current)) & (F.lit(current) < F.col("end"))
    ).select("key", F.lit(current).alias("month"))
    return (
        missing.union(again)
        .distinct()
        .withColumn("window", dates.monthly_window(F.col("month"), now))
    )


def missing_references(references: DataFrame, metadata: DataFrame, code: str) -> DataFrame:
    """Referenced codes without a metadata row: the dependency work list."""
    return references.select(code).distinct().join(metadata.select(code), code, "left_anti")


def preview(
    requests: DataFrame, coverage: DataFrame, now: datetime, open_dates: DataFrame | None = None
) -> DataFrame:
    """Dry run, one row: requested and due keys, jobs, and market-wide alternative."""
    due = clamp_due(requests, now).where("status != 'not due'")
    jobs = cov.continuity_gaps(
        due.select("key", "start", F.col("due_end").alias("end")), coverage
    )
    rows = (
        requests.select(F.lit("requests").alias("what"))
        .union(due.select(F.lit("due")))
        .union(jobs.select(F.lit("jobs")))
    )
    if open_dates is not None:
        rows = rows.union(open_dates.select(F.lit("dates")))
    count = lambda name: F.count_if(F.col("what") == name).alias(f"{name}")
    out = rows.agg(count("requests"), count("due"), count("jobs"), count("dates"))
    return out.withColumn(
        "estimated_requests",
        F.when((F.col("dates") > 0) & (F.col("dates") < F.col("jobs")), F.col("dates")).otherwise(
            F.col("jobs")
        ),
    )


def sliced(jobs: DataFrame, limit: int, open_dates: DataFrame | None = None) -> DataFrame:
    """(key, start, end, dates): jobs cut where a piece would ask for more than ``limit`` open dates.

    A piece holds as many dates as rows of one key can come back. Open dates are numbered once over
    all time; a job's first and last number say how many pieces it makes and where they begin, so
    no job meets its days. Pieces tile the job. Without a calendar every day is a date.
    """
    if limit < 1:
        raise ValueError("need limit >= 1")
    jobs = jobs.select("key", "start", "end").where("start < end").distinct()
    cut = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(n / limit), F.lit(1)) - 1))
    if open_dates is None:
        days = F.datediff("end", "start")
        pieces = jobs.select("*", cut(days).alias("_k"))
        start = F.date_add("start", (F.col("_k") * limit).cast("int"))
        end = F.least("end", F.date_add("start", ((F.col("_k") + 1) * limit).cast("int")))
        return pieces.select("key", start.alias("start"), end.alias("end"), F.datediff(end, start).cast("bigint").alias("dates"))
    # one row per civil date that is open or at an edge of a job, with the open dates before it
    edges = jobs.select(F.explode(F.array("start", "end")).alias("_day"), F.lit(0).alias("_open"))
    opened = open_dates.where("cal_date IS NOT NULL").select(F.col("cal_date").alias("_day"), F.lit(1).alias("_open"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    numbers = (
        opened.unionByName(edges)
        .groupBy("_day")
        .agg(F.max("_open").alias("_open"))
        .withColumn("_before", F.coalesce(F.sum("_open").over(earlier), F.lit(0)))
    )
    at = lambda name, n: numbers.select(F.col("_day").alias(name), F.col("_before").alias(n))
    placed = jobs.join(at("start", "_lo"), "start").join(at("end", "_hi"), "end")
    pieces = placed.select("*", cut(F.col("_hi") - F.col("_lo")).alias("_k"))
    begins = pieces.withColumn("_before", F.when(F.col("_k") > 0, F.col("_lo") + F.col("_k") * limit))
    dated = numbers.where("_open = 1").select("_before", "_day")
    begins = begins.join(dated, "_before", "left").withColumn("_from", F.coalesce("_day", "start"))
    along = Window.partitionBy("key", "start", "end").orderBy("_k")
    end = F.coalesce(F.lead("_from").over(along), F.col("end"))
    count = F.least(F.lit(limit).cast("bigint"), F.col("_hi") - F.col("_lo") - F.col("_k") * limit)
    cut_up = begins.select("key", F.col("_from").alias("_start"), end.alias("_end"), count.alias("dates"))
    return cut_up.select("key", F.col("_start").alias("start"), F.col("_end").alias("end"), "dates")
