"""Provider cells to typed values. A bad cell becomes null and is reported by ``invalid``.

A cell is what JSON said: its kind and its text. Kinds matter: a date or a name must be text, ``1``
is a flag but ``1.0`` isn't, and "5.0" is no whole number while the number 5.0 is. Plain text columns
count as cells of kind ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, WHOLE, FRACTION, FLAG, OTHER = "text", "whole", "fraction", "flag", "other"
CELL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])

_NUMBER = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*$"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def json_cell(value: Column) -> Column:
    """Kind and text of a variant; both null for JSON's null and for no value at all."""
    said = F.schema_of_variant(value)
    kind = (
        F.when(value.isNull() | (said == "VOID"), None)
        .when(said == "STRING", TEXT)
        .when(said == "BIGINT", WHOLE)
        .when(said.rlike("^(DECIMAL|DOUBLE|FLOAT)"), FRACTION)
        .when(said == "BOOLEAN", FLAG)
        .otherwise(OTHER)
    )
    return F.struct(kind.alias("kind"), F.try_variant_get(value, "$", "string").alias("text"))


def text_cell(value: Column) -> Column:
    return F.struct(F.when(value.isNotNull(), TEXT).alias("kind"), value.alias("text"))


def blank(cell: Column) -> Column:
    """Null or empty text."""
    return cell["kind"].isNull() | ((cell["kind"] == TEXT) & (cell["text"] == ""))


def provider_date(cell: Column) -> Column:
    """The first eight characters as ``YYYYMMDD``; a number is no date."""
    c = cell["text"]
    iso = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when((cell["kind"] == TEXT) & c.rlike("^[0-9]{8}"), iso.try_cast("date"))


def _flag_number(cell: Column, kind: str) -> Column:
    return F.when(cell["kind"] == FLAG, (cell["text"] == "true").cast("int").cast(kind))


def provider_double(cell: Column) -> Column:
    c = cell["text"]
    number = (cell["kind"] == TEXT) & c.rlike(_NUMBER) | cell["kind"].isin(WHOLE, FRACTION)
    return F.when(number, F.trim(c).try_cast("double")).otherwise(_flag_number(cell, "double"))


def provider_whole(cell: Column, kind: str = "tinyint") -> Column:
    """Whole text or number; a JSON fraction loses what follows its point."""
    c = cell["text"]
    return (
        F.when((cell["kind"] == WHOLE) | (cell["kind"] == TEXT) & c.rlike(_WHOLE), F.trim(c).try_cast(kind))
        .when(cell["kind"] == FRACTION, c.try_cast("double").try_cast(kind))
        .otherwise(_flag_number(cell, kind))
    )


def provider_flag(cell: Column) -> Column:
    return F.coalesce(cell["kind"].isin(TEXT, WHOLE) & (cell["text"] == "1"), F.lit(False))


def convert(cell: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return provider_date(cell)
    if isinstance(kind, T.DoubleType):
        return provider_double(cell)
    if isinstance(kind, (T.ByteType, T.IntegerType, T.LongType)):
        return provider_whole(cell, kind.simpleString())
    if isinstance(kind, T.BooleanType):
        return provider_flag(cell)
    return F.when(cell["kind"] == TEXT, cell["text"])


def invalid(cell: Column, value: Column, field: T.StructField) -> Column:
    """Why this cell, converted to ``value``, cannot fill the field; null when it can."""
    if isinstance(field.dataType, T.BooleanType):
        return F.lit(None).cast("string")
    empty = cell["kind"].isNull() if isinstance(field.dataType, T.StringType) else blank(cell)
    bad = F.when(~empty & value.isNull(), F.lit(f"{field.name}: bad value"))
    if field.nullable:
        return bad
    return F.when(empty, F.lit(f"{field.name}: required")).otherwise(bad)
