"""Landed responses to mutations and coverage, as whole-table joins instead of loops per key."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covspark.functions import dates
from covspark.operators import coverage as cov
from covspark.operators import mutate, validate
from covspark.operators.intervals import in_scope_join
from covspark.operators.mutate import Mutation
from covspark.plans import work
from covspark.spec import DatasetSpec


@dataclass(frozen=True)
class Ingest:
    """What to publish. ``problems`` and ``holes`` (keys whose coverage would not stay one
    interval) must be empty first; ``refetch`` is work still to do."""

    mutation: Mutation
    coverage: DataFrame | None
    problems: DataFrame
    refetch: DataFrame | None = None
    holes: DataFrame | None = None

    def publish(self, dataset, batch: tuple[str, int] | None = None) -> str:
        name = dataset.spec.name
        validate.require_none(self.problems, f"{name}: responses cannot be published")
        if self.holes is not None:
            validate.require_none(self.holes, f"{name}: coverage would have a hole")
        return dataset.publish([self.mutation], self.coverage, batch)


def _holes(coverage: DataFrame, delta: DataFrame, on_gap: str) -> DataFrame | None:
    return cov.holes(coverage, delta) if on_gap == "error" else None


def by_key(
    rows: DataFrame,
    jobs: DataFrame,
    spec: DatasetSpec,
    coverage: DataFrame,
    now: datetime,
    on_gap: str = "error",
) -> Ingest:
    """One ranged request per job (key, start, end): replace each range, extend coverage.

    A job without rows counts as resolved only under the dataset's missing-data policy.
    """
    day = F.col(spec.time_field)
    answered = rows.select(
        F.col(spec.partition_key).alias("key"), day.alias("_day"), dates.month(day).alias("_month")
    ).distinct()
    # jobs meet days per month, so a key with many jobs and many days makes no product of them
    months = F.explode_outer(dates.month_starts(F.col("start"), F.col("end")))
    hits = (
        jobs.select("key", "start", "end", months.alias("_month"))
        .join(answered, ["key", "_month"], "left")
        .groupBy("key", "start", "end")
        .agg(F.count_if((F.col("_day") >= F.col("start")) & (F.col("_day") < F.col("end"))).alias("days"))
    )
    status = work.classify_empty(
        spec.policy, dates.daily_window(F.date_sub("end", 1), now), F.col("days")
    )
    problems = hits.withColumn("status", status).where(
        F.col("status").isin(work.FAILURE, work.UNRESOLVED)
    )
    scopes = jobs.select("key", "start", "end")
    promised = scopes
    if spec.policy == "best-effort":
        promised = hits.where("days > 0").select("key", "start", "end")
    return Ingest(
        Mutation.ranges(rows.select(*spec.columns), scopes),
        cov.merge(coverage, promised, on_gap),
        problems,
        holes=_holes(coverage, promised, on_gap),
    )


def demanded_rows(rows: DataFrame, jobs: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows of a market-wide answer that some job asked for; the rest is dropped."""
    return in_scope_join(
        rows, jobs.select("key", "start", "end"), spec.partition_key, spec.time_field, "left_semi"
    )


def demanded_cells(jobs: DataFrame, open_dates: DataFrame) -> DataFrame:
    """(key, cal_date): the open days each job asked for, one row per cell.

    Jobs are spread over months, not days, and meet the dates there.
    """
    wanted = open_dates.select("cal_date", dates.month(F.col("cal_date")).alias("_month")).distinct()
    months = dates.month_starts(F.col("start"), F.col("end"))
    return (
        jobs.where("start < end")
        .select("key", "start", "end", F.explode(months).alias("_month"))
        .join(wanted, "_month")
        .where("cal_date >= start and cal_date < end")
        .select("key", "cal_date")
        .distinct()
    )


def absent_cells(
    rows: DataFrame, jobs: DataFrame, open_dates: DataFrame, spec: DatasetSpec
) -> DataFrame:
    """Demanded cells the market-wide answers did not contain."""
    have = rows.select(
        F.col(spec.partition_key).alias("key"), F.col(spec.time_field).alias("cal_date")
    )
    return demanded_cells(jobs, open_dates).join(have, ["key", "cal_date"], "left_anti")


def by_date(
    rows: DataFrame,
    jobs: DataFrame,
    open_dates: DataFrame,
    spec: DatasetSpec,
    coverage: DataFrame,
    now: datetime,
    refetched: DataFrame | None = None,
    on_gap: str = "error",
) -> Ingest:
    """Market-wide answers, one per open date, cut down to what the jobs asked for.

    A date whose answer reached the row limit may be cut off: its rows are not used, and
    ``refetch`` lists (key, date) requests whose rows come back as ``refetched``.
    """
    limit = spec.capabilities["row_limit"]
    per_date = validate.saturated(rows, [spec.time_field], limit)
    cut = per_date.where("saturated").select(F.col(spec.time_field).alias("cal_date"))
    whole = rows.join(cut.withColumnRenamed("cal_date", spec.time_field), spec.time_field, "left_anti")
    used = demanded_rows(whole, jobs, spec).select(*spec.columns)
    if refetched is not None:
        used = used.unionByName(
            demanded_rows(
                refetched.join(
                    cut.withColumnRenamed("cal_date", spec.time_field), spec.time_field, "left_semi"
                ),
                jobs,
                spec,
            ).select(*spec.columns)
        )
    refetch = demanded_cells(jobs, cut).select(
        "key", F.col("cal_date").alias("start"), F.date_add("cal_date", 1).alias("end")
    )
    # only days whose window has not passed can be unresolved, so only those are compared
    window = dates.daily_window(F.col("cal_date"), now)
    open_now = open_dates.where(window != dates.AFTER)
    if refetched is None:
        open_now = open_now.join(cut, "cal_date", "left_anti")
    unresolved = absent_cells(used, jobs, open_now, spec).withColumn("status", F.lit(work.UNRESOLVED))
    problems = unresolved
    if refetched is None:
        problems = problems.unionByName(
            demanded_cells(jobs, cut).withColumn("status", F.lit("refetch needed"))
        )
    return Ingest(
        Mutation.ranges(used, jobs),
        cov.merge(coverage, jobs, on_gap),
        problems,
        refetch,
        _holes(coverage, jobs, on_gap),
    )


def index_months(
    rows: DataFrame, months: DataFrame, spec: DatasetSpec, coverage: DataFrame, on_gap: str = "error"
) -> Ingest:
    """Whole months of index members, each answering one (key, month, window) of ``work.index_months``.

    Every asked month is replaced as a whole and covered, with or without rows: the current month
    may still be empty. Under the strict policy a month without rows is a failure. A month before its
    publication window can't be published, nor can rows of a month that nobody asked for.
    """
    asked = months.select("key", F.col("month").alias("start"), F.add_months("month", 1).alias("end"), "window").distinct()
    scopes = asked.select("key", "start", "end")
    early = asked.where(F.col("window") == dates.BEFORE).select("key", "start", "end", F.lit("before window").alias("status"))
    month = dates.month(F.col(spec.time_field)).alias("start")
    answered = rows.groupBy(F.col(spec.partition_key).alias("key"), month).agg(F.count("*").alias("rows"))
    met = scopes.join(answered, ["key", "start"], "full_outer")
    foreign = met.where("end IS NULL").select("key", "start", F.add_months("start", 1).alias("end"), F.lit("not asked for").alias("status"))
    problems = early.unionByName(foreign)
    if spec.policy == "strict":
        empty = met.where("rows IS NULL").select("key", "start", "end", F.lit(work.FAILURE).alias("status"))
        problems = problems.unionByName(empty)
    return Ingest(
        Mutation.ranges(rows.select(*spec.columns), scopes),
        cov.merge(coverage, scopes, on_gap),
        problems,
        holes=_holes(coverage, scopes, on_gap),
    )


def market_scopes(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(key, day, day+1) for every key each day's answer contained."""
    day = F.col(spec.time_field)
    return (
        rows.select(F.col(spec.partition_key).alias("key"), day.alias("start"))
        .distinct()
        .withColumn("end", F.date_add("start", 1))
    )


def market(
    rows: DataFrame,
    spec: DatasetSpec,
    coverage: DataFrame,
    on_gap: str = "error",
    check_limit: bool = True,
) -> Ingest:
    """Whole-market answers: every returned key has its day replaced and covered."""
    scopes = market_scopes(rows, spec)
    limit = spec.capabilities.get("row_limit")
    per_date = validate.saturated(rows, [spec.time_field], limit or 0)
    problems = per_date.where("saturated") if limit and check_limit else per_date.limit(0)
    return Ingest(
        Mutation.ranges(rows.select(*spec.columns), scopes),
        cov.merge(coverage, scopes, on_gap),
        problems,
        holes=_holes(coverage, scopes, on_gap),
    )


def calendar(
    rows: DataFrame, jobs: DataFrame, spec: DatasetSpec, coverage: DataFrame, now: datetime
) -> Ingest:
    """Calendar intervals: strict, so an interval without rows or in the future is refused."""
    plan = by_key(rows, jobs, spec, coverage, now)
    today = dates.market_time(now).date()
    ahead = jobs.where(F.col("end") > F.date_add(F.lit(today), 1)).select(
        "key", "start", "end", F.lit(0).cast("bigint").alias("days"), F.lit("future").alias("status")
    )
    return replace(plan, problems=plan.problems.unionByName(ahead))


def master_requests(spark) -> DataFrame:
    """The request list of a full security master: every listing status on every exchange."""
    # Listing statuses and exchanges of the provider.
    statuses, exchanges = ("L", "D", "P", "G"), ("SSE", "SZSE", "BSE")
    return spark.createDataFrame(
        [(s, e) for s in statuses for e in exchanges], "list_status string, exchange string"
    )


def snapshot(
    rows: DataFrame,
    spec: DatasetSpec,
    request: list[str],
    order: list[str],
    row_limit: int | None = None,
    on_conflict: str = "last",
) -> Ingest:
    """Complete replacement by the union of all answers; an empty union is refused.

    ``order`` ranks rows: a later answer, and a later row of one answer, wins its key.
    """
    limit = row_limit or spec.capabilities.get("row_limit", 6000)
    cut = validate.saturated(rows, request, limit).where("saturated")
    ranked = rows.select(*spec.columns, F.struct(*order).alias("_at"))
    merged = mutate.merge_last_wins(None, ranked, list(spec.primary_key), "_at", on_conflict)
    none = rows.agg(F.count("*").alias("rows")).where("rows = 0")
    problems = cut.select(F.lit("truncated").alias("problem"), "rows").union(
        none.select(F.lit("empty snapshot"), "rows")
    )
    return Ingest(Mutation.complete(merged.select(*spec.columns)), None, problems)


def upsert(rows: DataFrame, requests: DataFrame, spec: DatasetSpec) -> Ingest:
    """One exact answer per requested id, replaced by primary key."""
    problems = validate.exact_match(requests, rows, spec.primary_key[0])
    return Ingest(Mutation.primary_keys(rows.select(*spec.columns)), None, problems)
