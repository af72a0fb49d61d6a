"""Dataset status: grouped counts and the state of the current revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covspark.operators import coverage as cov


def by_group(df: DataFrame, group: str, name: str = "rows") -> DataFrame:
    """Rows per value of a declared status field, e.g. securities per listing status."""
    return df.groupBy(group).agg(F.count("*").alias(name))


def members_per_index(weights: DataFrame) -> DataFrame:
    """Distinct constituents of every index."""
    return weights.groupBy("index_code").agg(F.count_distinct("con_code").alias("constituents"))


def summary(dataset) -> dict:
    """State, publication, coverage summary and stored bytes of a dataset."""
    manifest = dataset.manifest
    out = {
        "dataset": dataset.spec.name,
        "state": "ready" if manifest else "uninitialized",
        "publication_id": manifest.publication_id if manifest else None,
        "revision": manifest.revision if manifest else 0,
        "covered_keys": None,
        "covered_start": None,
        "covered_end": None,
        "storage_bytes": dataset.storage_bytes() if manifest else 0,
    }
    if manifest and dataset.spec.time_field:
        row = cov.summary(dataset.coverage()).first()
        out |= {
            "covered_keys": row["keys"],
            "covered_start": row["start"],
            "covered_end": row["end"],
        }
    return out
