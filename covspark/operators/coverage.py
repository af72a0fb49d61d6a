"""Per-key coverage: one half-open interval per key."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covspark.errors import CoverageError, QueryError, UnsupportedCoverageError
from covspark.operators import intervals
from covspark.spec import DatasetSpec

_PAIR = "array<struct<start:date,end:date>>"


def require_time(spec: DatasetSpec) -> None:
    if spec.time_field is None:
        raise UnsupportedCoverageError(f"{spec.name} has no time field, so no coverage")


def derive(facts: DataFrame, key: str, day: str) -> DataFrame:
    """Coverage hull implied by the facts themselves."""
    return (
        facts.where(F.col(key).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.min(day).alias("start"), F.date_add(F.max(day), 1).alias("end"))
    )


def read(coverage: DataFrame, keys: list[str] | DataFrame | None = None) -> DataFrame:
    """Coverage rows of some keys; sort them where they are shown."""
    if isinstance(keys, DataFrame):
        coverage = coverage.join(keys.select("key"), "key", "left_semi")
    elif keys is not None:
        coverage = coverage.where(F.col("key").isin(list(keys)) if keys else F.lit(False))
    return coverage


def summary(coverage: DataFrame) -> DataFrame:
    """One row: covered keys, earliest start and latest end. Keys are unique by contract."""
    return coverage.agg(
        F.count("key").alias("keys"), F.min("start").alias("start"), F.max("end").alias("end")
    )


def requests_for(keys: DataFrame, start: date, end: date) -> DataFrame:
    return keys.select("key", F.lit(start).alias("start"), F.lit(end).alias("end"))


def _with_coverage(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    held = coverage.select(
        "key", F.col("start").alias("covered_start"), F.col("end").alias("covered_end")
    )
    return requests.join(held, "key", "left")


def _keep(*pairs: tuple[Column, Column, Column]) -> Column:
    """Array of the (when, start, end) triples that hold and are not empty."""
    return F.array_compact(
        F.array(
            *[
                F.when(when & (start < end), F.struct(start.alias("start"), end.alias("end")))
                for when, start, end in pairs
            ]
        )
    ).cast(_PAIR)


def _gap_array() -> Column:
    s, e, cs, ce = (F.col(c) for c in ("start", "end", "covered_start", "covered_end"))
    return _keep(
        (cs.isNull(), s, e),
        (cs.isNotNull(), s, F.least(e, cs)),
        (cs.isNotNull(), F.greatest(s, ce), e),
    )


def gaps(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """The exact uncovered parts of each request: (…request…, gap_start, gap_end)."""
    return (
        _with_coverage(requests, coverage)
        .withColumn("_gap", F.explode(_gap_array()))
        .select(
            *requests.columns,
            F.col("_gap.start").alias("gap_start"),
            F.col("_gap.end").alias("gap_end"),
        )
    )


def report(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per request: complete flag, covered interval and the list of missing intervals."""
    return (
        _with_coverage(requests, coverage)
        .withColumn("missing", _gap_array())
        .withColumn("complete", F.size("missing") == 0)
    )


def enforce(
    spec: DatasetSpec,
    coverage: DataFrame,
    keys: list[str] | DataFrame | None,
    time_range: tuple[date, date] | None,
    shown: int = 20,
) -> None:
    """Raise when any key lacks part of the range. The error holds all gaps and names some."""
    require_time(spec)
    if keys is None or time_range is None:
        raise QueryError("required coverage needs explicit keys and a time range")
    if not isinstance(keys, DataFrame):
        if not keys:
            return
        keys = coverage.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    missing = gaps(requests_for(keys, *time_range), coverage)
    first = missing.limit(shown + 1).collect()
    if first:
        total = len(first) if len(first) <= shown else missing.count()
        found: dict[str, list[tuple]] = {}
        for row in first[:shown]:
            found.setdefault(row["key"], []).append((row["gap_start"], row["gap_end"]))
        raise CoverageError(spec.name, found, total, missing)


def continuity_gaps(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """What to fetch so that each key stays one interval after the fetch.

    A request that touches nothing covered is stretched up to the covered interval.
    """
    s, e, cs, ce = (F.col(c) for c in ("start", "end", "covered_start", "covered_end"))
    work = _keep(
        (cs.isNull(), s, e),
        (cs.isNotNull() & (s < cs), s, cs),
        (cs.isNotNull() & (e > ce), ce, e),
    )
    return (
        _with_coverage(requests, coverage)
        .withColumn("_work", F.explode(work))
        .select(
            *requests.columns,
            F.col("_work.start").alias("work_start"),
            F.col("_work.end").alias("work_end"),
        )
    )


ON_GAP = ("hull", "keep_left", "error")


def merge(coverage: DataFrame, delta: DataFrame, on_gap: str = "error") -> DataFrame:
    """Coverage after fetching ``delta`` (any number of intervals per key).

    When the parts of a key do not join up, ``hull`` covers the hole as well,
    ``keep_left`` keeps the earliest part, and ``error`` fails the row that shows it.
    """
    if on_gap not in ON_GAP:
        raise ValueError(f"on_gap must be one of {ON_GAP}")
    both = coverage.select("key", "start", "end").unionByName(delta.select("key", "start", "end"))
    if on_gap == "hull":
        return both.groupBy("key").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = intervals.union(both, ["key"])
    if on_gap == "error":
        parts = parts.withColumn(
            "intervals",
            F.when(F.size("intervals") == 1, F.col("intervals")).otherwise(
                F.raise_error(
                    F.concat(F.lit("coverage would have a hole for key "), F.col("key"))
                )
            ),
        )
    return parts.select(
        "key",
        F.get("intervals", F.lit(0))["start"].alias("start"),
        F.get("intervals", F.lit(0))["end"].alias("end"),
    )


def holes(coverage: DataFrame, delta: DataFrame) -> DataFrame:
    """Keys whose parts would not join up, with the number of parts."""
    both = coverage.select("key", "start", "end").unionByName(delta.select("key", "start", "end"))
    return (
        intervals.union(both, ["key"])
        .select("key", F.size("intervals").alias("parts"))
        .where("parts > 1")
    )


def outside(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """Refresh requests that are not wholly inside coverage."""
    return _with_coverage(requests, coverage).where(
        F.col("covered_start").isNull()
        | (F.col("start") < F.col("covered_start"))
        | (F.col("end") > F.col("covered_end"))
    )
