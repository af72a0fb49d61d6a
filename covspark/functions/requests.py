"""Canonical request keys: equal requests get equal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operations whose equal requests share one run.
COALESCING = ("complete", "refresh")


def canonical_list(c: Column) -> Column:
    """Operand order and repeats do not matter."""
    return F.sort_array(F.array_distinct(c))


def request_key(dataset: Column, operation: Column, operands: dict[str, Column]) -> Column:
    """Compact JSON with sorted names and operand lists; null when requests never coalesce."""
    body = F.struct(*[operands[name].alias(name) for name in sorted(operands)])
    key = F.to_json(
        F.struct(
            dataset.alias("dataset"), body.alias("operands"), operation.alias("operation")
        ),
        {"ignoreNullFields": "false"},
    )
    return F.when(operation.isin(*COALESCING), key)
