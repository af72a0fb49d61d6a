"""Selector text: direct securities and dated index references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix and code patterns of the provider's selector grammar.
PREFIX = "tushare:"
INDEX_CODE = r"[A-Za-z0-9]+\.[A-Za-z]+"
SECURITY = r"^[0-9]{6}\.(SH|SZ|BJ)$"
MONTH_SUFFIX = r"[0-9]{4}(0[1-9]|1[0-2])"


def parse_selector(c: Column, prefix: str = PREFIX) -> Column:
    """struct(kind, code, selection): kind is security, index, all, stored or invalid.

    An index selection is ``range`` (no suffix), ``latest`` or a ``YYYYMM`` month.
    """
    pattern = f"^{prefix}({INDEX_CODE})(@(latest|{MONTH_SUFFIX}))?$"
    suffix = F.regexp_extract(c, pattern, 3)
    kind = (
        F.when(c.isin("all", "stored"), c)
        .when(c.rlike(SECURITY), "security")
        .when(c.rlike(pattern), "index")
        .otherwise("invalid")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "security", c)
        .when(kind == "index", F.regexp_extract(c, pattern, 1))
        .alias("code"),
        F.when(kind == "index", F.when(suffix == "", "range").otherwise(suffix)).alias("selection"),
    )
