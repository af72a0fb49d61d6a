"""Contract checks. Each returns the offending rows; ``require_none`` raises at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covspark.errors import ContractError
from covspark.operators.intervals import in_scope_join
from covspark.spec import DatasetSpec


def require_none(violations: DataFrame, message: str, sample: int = 5) -> None:
    rows = violations.take(sample)
    if rows:
        raise ContractError(message, [row.asDict() for row in rows])


def schema(df: DataFrame, spec: DatasetSpec) -> None:
    """Names, types and order must equal the declared ones."""
    got = [(f.name, f.dataType) for f in df.schema]
    want = [(f.name, f.dataType) for f in spec.schema]
    if got != want:
        raise ContractError(f"{spec.name}: schema {got} differs from the declared {want}")


def required(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows with null required fields, and which fields those are."""
    missing = F.array_compact(
        F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in spec.required])
    )
    return df.withColumn("missing", missing).where(F.size("missing") > 0)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Key tuples that occur more than once, with their count. Nulls equal each other."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def null_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, and rows whose key holds a null."""
    any_null = F.lit(False)
    for name in key:
        any_null = any_null | F.col(name).isNull()
    return df.agg(
        F.count("*").alias("rows"), F.count_if(any_null).alias("null_key_rows")
    )


def keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Null or repeated key tuples, in one aggregation."""
    any_null = F.lit(False)
    for name in key:
        any_null = any_null | F.col(name).isNull()
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("rows"))
        .withColumn(
            "problem", F.when(any_null, "null key").when(F.col("rows") > 1, "duplicate key")
        )
        .where(F.col("problem").isNotNull())
    )


def in_scope(rows: DataFrame, scopes: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Incoming rows of a range replacement that fall outside every declared scope."""
    return in_scope_join(rows, scopes, spec.partition_key, spec.time_field, "left_anti")


def coverage(df: DataFrame) -> DataFrame:
    """Keys with an empty name, an empty interval, a null, or more than one interval."""
    bad = (
        F.col("key").isNull()
        | (F.col("key") == "")
        | F.col("start").isNull()
        | F.col("end").isNull()
        | (F.col("start") >= F.col("end"))
    )
    return (
        df.groupBy("key")
        .agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad_rows"))
        .where("rows > 1 or bad_rows > 0")
    )


def exact_match(requests: DataFrame, rows: DataFrame, id_column: str) -> DataFrame:
    """Requests (request_id, wanted) not answered by exactly the one wanted id, and answers to no request.

    ``rows`` came back, ``hits`` of them with the wanted id; an answer nobody asked for has no
    ``wanted``. Counts are taken per request and id before the match.
    """
    hits = rows.groupBy("request_id", F.col(id_column).alias("wanted")).agg(F.count("*").alias("hits"))
    counts = hits.groupBy("request_id").agg(F.sum("hits").alias("rows"))
    asked = requests.select("request_id", "wanted", F.lit(True).alias("_asked"))
    met = asked.join(counts, "request_id", "full_outer").join(hits, ["request_id", "wanted"], "left")
    exact = F.col("_asked") & (F.col("rows") == 1) & (F.col("hits") == 1)
    return met.where(~F.coalesce(exact, F.lit(False))).select(
        "request_id", "wanted", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("hits", F.lit(0)).alias("hits")
    )


def saturated(rows: DataFrame, request: list[str], row_limit: int) -> DataFrame:
    """Row count per request, and whether it reached the limit and may be cut off."""
    return (
        rows.groupBy(*request)
        .agg(F.count("*").alias("rows"))
        .withColumn("saturated", F.col("rows") >= row_limit)
    )


def unanswered(requests: DataFrame, rows: DataFrame, request: list[str]) -> DataFrame:
    """Requests that returned no row at all."""
    return requests.join(rows.select(*request), request, "left_anti")
