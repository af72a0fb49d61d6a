"""Landed provider responses: ``{code, msg, data: {fields, items}}`` as JSON text per response.

``classify`` separates protocol errors from good responses, ``explode_items`` turns items
into rows of named cells with their JSON kinds, and ``normalize`` types them against a dataset
contract. Bad rows are kept and named in ``violations``; nothing is dropped on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covspark.functions.provider import convert, invalid, json_cell, text_cell
from covspark.spec import DatasetSpec



def classify(df: DataFrame, text: str = "response") -> DataFrame:
    """Adds code, msg, fields, items and ``error_kind`` (null when the response is usable)."""
    parsed = df.withColumn("_v", F.try_parse_json(text))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    is_object = F.col("_v").isNotNull() & F.ltrim(text).startswith("{")
    code_kind = F.schema_of_variant(get("$.code", "variant"))
    out = (
        parsed.withColumn("code", F.when(code_kind == "BIGINT", get("$.code", "bigint")))
        .withColumn("msg", get("$.msg", "string"))
        .withColumn("_data", get("$.data", "map<string,variant>"))
        .withColumn("fields", get("$.data.fields", "array<string>"))
        .withColumn("items", get("$.data.items", "array<array<variant>>"))
    )
    kind = (
        F.when(F.col("_v").isNull(), "not json")
        .when(~is_object, "not an object")
        .when(F.col("code").isNull(), "code missing or invalid")
        .when(F.col("code") != 0, "provider error")
        .when(F.col("_data").isNull(), "data missing or invalid")
        .when(F.col("fields").isNull() | F.col("items").isNull(), "fields or items missing")
    )
    return out.withColumn("error_kind", kind).drop("_v", "_data")


def missing_fields(names: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(n) for n in names]), F.col("fields"))


def explode_items(responses: DataFrame, spec: DatasetSpec, keep: Sequence[str] = ()) -> DataFrame:
    """One row per item of every usable response: ``keep`` columns, row_no, ragged, cells.

    A cell is a struct of its JSON kind and its text. A field named twice takes its last position. Undeclared fields are ignored, and a
    response without a declared field gives no rows (see ``response_problems``).
    """
    names = [n for n in spec.provided]
    flipped = F.reverse("fields")
    places = F.struct(
        *[(F.size("fields") - F.array_position(flipped, n)).cast("int").alias(n) for n in names]
    )
    rows = (
        responses.where(F.col("error_kind").isNull() & (F.size(missing_fields(names)) == 0))
        .select(*keep, "items", F.size("fields").alias("_width"), places.alias("_at"))
        .select(*keep, "_width", "_at", F.posexplode("items"))
        .withColumnRenamed("pos", "row_no")
    )
    picked = rows.select(
        *keep,
        "row_no",
        (F.size("col") != F.col("_width")).alias("ragged"),
        *[F.get("col", F.col(f"_at.{n}")).alias(n) for n in names],
    )
    return picked.withColumns({n: json_cell(F.col(n)) for n in names})


def response_problems(responses: DataFrame, spec: DatasetSpec, key: str) -> DataFrame:
    """Responses refused as a whole: protocol errors and missing declared fields."""
    absent = missing_fields(spec.provided)
    problem = F.coalesce(
        F.col("error_kind"),
        F.when(
            F.size(absent) > 0, F.concat(F.lit("missing fields: "), F.array_join(absent, ", "))
        ),
    )
    return responses.select(key, "code", "msg", problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def normalize(rows: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Typed columns plus ``violations``, an array that is empty for a good row.

    Declared columns are cells of ``explode_items`` or plain text.
    """
    declared = {f.name: f for f in spec.schema}
    texts = [n for n in spec.provided if n in declared]
    others = [c for c in rows.columns if c not in texts and c != "ragged"]
    plain = [n for n in texts if isinstance(rows.schema[n].dataType, T.StringType)]
    cells = rows.withColumns({n: text_cell(F.col(n)) for n in plain}) if plain else rows
    # staged, so that every cell is read and converted once
    staged = cells.withColumnsRenamed({n: f"_cell_{n}" for n in texts}).withColumns(
        {n: convert(F.col(f"_cell_{n}"), declared[n].dataType) for n in texts}
    )
    problems = [invalid(F.col(f"_cell_{n}"), F.col(n), declared[n]) for n in texts]
    if "ragged" in rows.columns:
        problems.append(F.when(F.col("ragged"), F.lit("ragged item")))
    return staged.select(
        *others, *texts, F.array_compact(F.array(*problems)).alias("violations")
    )


def typed_rows(rows: DataFrame, spec: DatasetSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Good rows in the declared schema after the dataset's own row rule."""
    good = rows.where(F.size("violations") == 0).drop("violations")
    return spec.normalize(good).select(*keep, *spec.columns)


def table_from_responses(
    responses: DataFrame, spec: DatasetSpec, key: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(typed rows, violating rows, refused responses) of raw responses with a ``response`` text column.

    ``key`` names the responses in the last; without one each is named by its text.
    """
    read = classify(responses)
    rows = normalize(explode_items(read, spec), spec)
    refused = response_problems(read, spec, key or "response")
    return typed_rows(rows, spec), rows.where(F.size("violations") > 0), refused
