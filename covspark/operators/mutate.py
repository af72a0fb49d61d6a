"""Declarative replacements applied as joins: whole table, by primary key, by key and range."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covspark.errors import ContractError
from covspark.operators import validate
from covspark.operators.intervals import in_scope_join
from covspark.spec import COVERAGE_SCHEMA, DatasetSpec

COMPLETE, PRIMARY_KEYS, RANGE = "complete", "primary_keys", "range"


@dataclass(frozen=True)
class Mutation:
    """``rows`` replace what the mutation deletes; ``scopes`` is set for ranges only."""

    kind: str
    rows: DataFrame
    scopes: DataFrame | None = None

    @classmethod
    def complete(cls, rows: DataFrame) -> "Mutation":
        return cls(COMPLETE, rows)

    @classmethod
    def primary_keys(cls, rows: DataFrame) -> "Mutation":
        return cls(PRIMARY_KEYS, rows)

    @classmethod
    def ranges(cls, rows: DataFrame, scopes: DataFrame) -> "Mutation":
        """Replace many (key, start, end) scopes at once."""
        return cls(RANGE, rows, scopes.select("key", "start", "end"))

    @classmethod
    def range(cls, rows: DataFrame, key: str, start: date, end: date) -> "Mutation":
        if not key or start >= end:
            raise ContractError("a range replacement needs a key and a non-empty range")
        scope = rows.sparkSession.createDataFrame([(key, start, end)], COVERAGE_SCHEMA)
        return cls(RANGE, rows, scope)


def upsert(base: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Delete rows whose key comes in, then add all incoming rows."""
    kept = base.join(rows.select(*key), list(key), "left_anti")
    return kept.select(*base.columns).unionByName(rows)


def replace_ranges(
    base: DataFrame, rows: DataFrame, scopes: DataFrame, key: str, time: str
) -> DataFrame:
    """Delete rows inside any scope of their key, then add the incoming rows.

    Rows with a null key or time are in no scope and stay.
    """
    return in_scope_join(base, scopes, key, time, "left_anti").unionByName(rows)


def _tag(df: DataFrame, seq: int) -> DataFrame:
    return df.withColumn("_row_seq", F.lit(seq))


def apply_tagged(
    rows: DataFrame,
    spec: DatasetSpec,
    scopes: DataFrame | None = None,
    upserts: DataFrame | None = None,
) -> DataFrame:
    """Apply any number of replacements in one pass over rows tagged ``_row_seq``.

    The base has ``_row_seq`` -1 and mutation i brings rows tagged i. A row goes when
    a later scope (key, start, end, seq) or a later upsert row (key columns, seq) hits it,
    which equals applying the mutations one after another.
    """
    if scopes is not None:
        rows = in_scope_join(
            rows,
            scopes,
            spec.partition_key,
            spec.time_field,
            "left_anti",
            F.col("_seq") > F.col("_row_seq"),
        )
    if upserts is not None:
        latest = upserts.groupBy(*spec.primary_key).agg(F.max("seq").alias("_upsert_seq"))
        latest = latest.select(
            *[F.col(c).alias(f"_pk_{c}") for c in spec.primary_key], "_upsert_seq"
        )
        on = reduce(
            Column.__and__, [F.col(c) == F.col(f"_pk_{c}") for c in spec.primary_key]
        ) & (F.col("_upsert_seq") > F.col("_row_seq"))
        rows = rows.join(latest, on, "left_anti")
    return rows.drop("_row_seq")


def apply(base: DataFrame | None, mutations: Sequence[Mutation], spec: DatasetSpec) -> DataFrame:
    """The table after all mutations in order. Nothing before the last complete one matters."""
    last = max((i for i, m in enumerate(mutations) if m.kind == COMPLETE), default=None)
    if last is not None:
        base, mutations = mutations[last].rows, mutations[last + 1 :]
    if base is None:
        base = mutations[0].rows.limit(0)
    if not mutations:
        return base
    if len(mutations) == 1:
        (only,) = mutations
        if only.kind == PRIMARY_KEYS:
            return upsert(base, only.rows, spec.primary_key)
        return replace_ranges(base, only.rows, only.scopes, spec.partition_key, spec.time_field)

    # nothing can remove what the last mutation brings
    last = mutations[-1].rows
    rows = reduce(
        DataFrame.unionByName,
        [_tag(m.rows, i) for i, m in enumerate(mutations[:-1])],
        _tag(base, -1),
    )
    scopes = [
        m.scopes.withColumn("seq", F.lit(i)) for i, m in enumerate(mutations) if m.kind == RANGE
    ]
    upserts = [
        m.rows.select(*spec.primary_key, F.lit(i).alias("seq"))
        for i, m in enumerate(mutations)
        if m.kind == PRIMARY_KEYS
    ]
    return apply_tagged(
        rows,
        spec,
        reduce(DataFrame.unionByName, scopes) if scopes else None,
        reduce(DataFrame.unionByName, upserts) if upserts else None,
    ).unionByName(last)


def check(mutation: Mutation, spec: DatasetSpec) -> None:
    """Schema of every mutation; rows of a range replacement must be inside its scopes."""
    validate.schema(mutation.rows, spec)
    if mutation.kind != RANGE:
        return
    if not spec.partition_key or not spec.time_field:
        raise ContractError(f"{spec.name}: range replacement needs a partition key and time field")
    validate.require_none(
        validate.in_scope(mutation.rows, mutation.scopes, spec),
        f"{spec.name}: rows outside the declared key and range",
    )


ON_CONFLICT = ("last", "error")


def merge_last_wins(
    base: DataFrame | None,
    rows: DataFrame,
    key: Sequence[str],
    position: str,
    on_conflict: str = "last",
) -> DataFrame:
    """Union by primary key: incoming beats base, and a later ``position`` beats an earlier.

    With ``error``, different incoming rows for one key fail instead.
    """
    if on_conflict not in ON_CONFLICT:
        raise ValueError(f"on_conflict must be one of {ON_CONFLICT}")
    columns = [c for c in rows.columns if c != position]
    values = [c for c in columns if c not in key]
    tagged = rows.withColumn("_rank", F.struct(F.lit(1).alias("source"), F.col(position).alias("at")))
    if base is not None:
        kind = rows.schema[position].dataType
        old = base.select(*columns).withColumn(
            "_rank",
            F.struct(F.lit(0).alias("source"), F.lit(None).cast(kind).alias("at")),
        )
        tagged = old.unionByName(tagged.drop(position))
    body = F.struct(*(values or [F.lit(0).alias("_none")]))
    found = [F.max_by(body, F.col("_rank")).alias("_row")]
    if on_conflict == "error":
        from_new = F.when(F.col("_rank.source") == 1, body)
        found += [F.min(from_new).alias("_low"), F.max(from_new).alias("_high")]
    merged = tagged.groupBy(*key).agg(*found)
    if on_conflict == "error":
        clash = F.raise_error(
            F.concat_ws(" ", F.lit("conflicting rows for key"), *[F.col(k).cast("string") for k in key])
        )
        merged = merged.withColumn(
            "_row",
            F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_row")).otherwise(clash),
        )
    return merged.select(
        *[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in columns]
    )
