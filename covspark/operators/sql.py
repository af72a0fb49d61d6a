"""Guarded SQL: one SELECT over the single relation ``data``.

Spark's own parser reads the text; the guard only looks at the resulting plan, so
keywords inside string literals are fine and a second relation cannot hide anywhere.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from covspark.errors import QueryError
from covspark.operators.query import check_limit

# Plan nodes one SELECT over one relation can consist of.
_ALLOWED = {
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit",
    "Offset", "Distinct", "SubqueryAlias", "UnresolvedRelation", "WithWindowDefinition",
    "Window",
}
_BARRED_FUNCTIONS = {"java_method", "reflect", "try_reflect"}
MAX_ROWS = 1000
_NULLS = re.compile(r"\bNULLS\s+(FIRST|LAST)\s*$", re.IGNORECASE)


def _sequence(scala):
    return [scala.apply(i) for i in range(scala.size())]


def guard(spark: SparkSession, text: str) -> list[int]:
    """Refuse anything but one SELECT whose only source is ``data``.

    Returns the places right after each ascending sort key that doesn't say where nulls go.
    """
    if not isinstance(text, str) or not text.strip():
        raise QueryError("the SQL text is empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as exc:
        raise QueryError(f"not a single valid statement: {exc}") from exc
    relations = blocks = 0
    places: list[int] = []
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        kind = node.nodeName()
        if kind not in _ALLOWED:
            raise QueryError(f"{kind} is not allowed; use one SELECT over data")
        if kind == "UnresolvedRelation":
            parts = _sequence(node.multipartIdentifier())
            if [p.lower() for p in parts] != ["data"]:
                raise QueryError(f"only the relation data may be read, not {'.'.join(parts)}")
            relations += 1
        blocks += kind in ("Project", "Aggregate")
        for expression in _sequence(node.expressions()):
            places += _guard_expression(expression, text)
        nodes += _sequence(node.children())
    if blocks != 1:
        raise QueryError("the text must hold exactly one SELECT")
    if relations != 1:
        raise QueryError("the query must read the relation data")
    return places


def _guard_expression(expression, text: str) -> list[int]:
    pending, places = [expression], []
    while pending:
        item = pending.pop()
        name = item.getClass().getSimpleName()
        if "Subquery" in name or name in ("Exists", "ListQuery", "LateralSubquery"):
            raise QueryError("subqueries are not allowed")
        if name == "UnresolvedFunction":
            called = _sequence(item.nameParts())[-1].lower()
            if called in _BARRED_FUNCTIONS:
                raise QueryError(f"function {called} is not allowed")
        if name == "SortOrder" and item.direction().toString() == "Ascending":
            origin = item.origin()
            start, stop = origin.startIndex().get(), origin.stopIndex().get() + 1
            if not _NULLS.search(text[start:stop]):
                places.append(stop)
        pending += _sequence(item.children())
    return places


def run(df: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Run guarded SQL with ``df`` as the relation ``data``; nulls sort last unless the text says otherwise.

    The relation stands behind a view of its own name, so statements in other threads don't meet.
    """
    if limit is not None:
        check_limit(limit, 1, MAX_ROWS)
    spark = df.sparkSession
    for place in sorted(set(guard(spark, text)), reverse=True):
        text = f"{text[:place]} NULLS LAST{text[place:]}"
    view = f"covspark_{uuid.uuid4().hex}"
    df.createTempView(view)
    try:
        out = spark.sql(f"WITH data AS (SELECT * FROM {view}) {text}")
    except Exception as exc:
        raise QueryError(f"dataset SQL failed: {exc}") from exc
    finally:
        spark.catalog.dropTempView(view)
    return out if limit is None else out.limit(limit)
