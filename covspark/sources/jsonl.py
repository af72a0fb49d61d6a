"""JSON-lines log source. Malformed and non-object lines are skipped, or counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The record layouts of event and task logs.
EVENTS = (
    "event_id string, timestamp double, kind string, severity string, message string, "
    "context map<string,string>, reference string"
)
LOG_LINES = (
    "type string, time double, message string, severity string, code string, "
    "context map<string,string>, count bigint"
)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Object lines only, whatever columns are used later; a field of another type is null."""
    found = parse(spark.read.text(path), schema)
    return found.where(~F.col("skipped")).select("record.*")


def parse(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Text lines to records with ``skipped`` set on lines that are not JSON objects."""
    ok = F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{")
    record = F.from_json(text, schema)
    return lines.withColumn("skipped", ~F.coalesce(ok, F.lit(False))).withColumn(
        "record", F.when(~F.col("skipped"), record)
    )


def task_lines(records: DataFrame) -> DataFrame:
    """Log records with a message; diagnostics keep severity, code, context and count."""
    diagnostic = F.coalesce(F.col("type") == "diagnostic", F.lit(False))
    only = lambda c: F.when(diagnostic, c)
    others = [c for c in records.columns if c not in ("type", "severity", "code", "context", "count")]
    return records.where(F.col("message").isNotNull()).select(
        *others,
        F.when(diagnostic, "task.diagnostic").otherwise("log").alias("type"),
        only(F.col("severity")).alias("severity"),
        only(F.col("code")).alias("code"),
        only(F.col("context")).alias("context"),
        only(F.coalesce("count", F.lit(1))).alias("count"),
    )
