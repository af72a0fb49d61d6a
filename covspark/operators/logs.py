"""Event-log and task-record operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.operators import ordered

# Record kinds, states, severities and the default history and view sizes.
ACKNOWLEDGEMENT = "acknowledgement"
SEVERITIES = ("info", "warning", "error")
DIAGNOSTIC_SEVERITIES = ("warning", "error")
TERMINAL = ("succeeded", "failed", "canceled")
ACTIVE = ("queued", "running", "waiting", "canceling")
RUNNING = ("running", "waiting", "canceling")
HISTORY_ROWS = 1000
VISIBLE_DIAGNOSTICS = 10
MIN_PREFIX = 8


def _is_ack() -> Column:
    return F.coalesce(F.col("kind") == ACKNOWLEDGEMENT, F.lit(False))


def acknowledged(events: DataFrame) -> DataFrame:
    """Primary events with a mark: some acknowledgement row refers to the event's id."""
    acks = (
        events.where(_is_ack() & (F.col("reference") != ""))
        .select(F.col("reference").alias("event_id"))
        .distinct()
        .withColumn("_ack", F.lit(True))
    )
    primary = events.where(~_is_ack()).drop("reference")
    return (
        primary.join(acks, "event_id", "left")
        .withColumn("acknowledged", F.coalesce("_ack", F.lit(False)))
        .drop("_ack")
    )


def list_events(
    events: DataFrame,
    unread: bool = False,
    since: float | datetime | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Primary events, newest first."""
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}")
    out = acknowledged(events)
    if unread:
        out = out.where(~F.col("acknowledged"))
    if since is not None:
        out = out.where(F.col("timestamp") >= F.lit(since))
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    return out.orderBy(F.col("timestamp").desc(), "event_id")


def list_handles(
    handles: DataFrame, dataset: str | None = None, status: str | None = None
) -> DataFrame:
    """Task handles, most recently created first."""
    for name, value in (("dataset", dataset), ("status", status)):
        if value is not None:
            handles = handles.where(F.col(name) == value)
    return handles.orderBy(F.col("created_at").desc(), "handle_id")


def newest_terminal(handles: DataFrame) -> DataFrame:
    """The most recently updated finished task of each dataset; ties keep the first seen."""
    body = F.struct(*[c for c in handles.columns if c != "dataset"])
    best = (
        handles.where(F.col("status").isin(*TERMINAL))
        .groupBy("dataset")
        .agg(F.min_by(body, F.struct(-F.col("updated_at"), F.col("handle_id"))).alias("_best"))
    )
    return best.select("dataset", "_best.*")


def retained(handles: DataFrame, keep: int = HISTORY_ROWS) -> DataFrame:
    """All unfinished handles, and the newest finished ones of each dataset."""
    done = F.col("status").isin(*TERMINAL)
    newest = ordered.top_n(
        handles.where(done), ["dataset"], [F.col("updated_at").desc(), F.col("handle_id")], keep
    )
    return handles.where(~done).unionByName(newest.select(*handles.columns))


def retained_executions(executions: DataFrame, handles: DataFrame) -> DataFrame:
    """Executions some kept handle still refers to."""
    return executions.join(handles.select("execution_id"), "execution_id", "left_semi")


def subscribers(handles: DataFrame, executions: DataFrame) -> DataFrame:
    """Unfinished handles per execution."""
    live = handles.groupBy("execution_id").agg(
        F.count_if(~F.col("status").isin(*TERMINAL)).alias("subscribers")
    )
    return executions.select("execution_id").join(live, "execution_id", "left").withColumn(
        "subscribers", F.coalesce("subscribers", F.lit(0))
    )


def queue_lengths(executions: DataFrame) -> DataFrame:
    return executions.groupBy("dataset").agg(
        F.count_if(F.col("status") == "queued").alias("queued"),
        F.count_if(F.col("status").isin(*RUNNING)).alias("running"),
    )


def _counted(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where(
        F.col("severity").isin(*DIAGNOSTIC_SEVERITIES) & (F.col("count") >= 1)
    )


def diagnostic_totals(diagnostics: DataFrame, key: str = "execution_id") -> DataFrame:
    """Weighted warnings and errors per key."""
    totals = [
        F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).alias(f"{s}s")
        for s in DIAGNOSTIC_SEVERITIES
    ]
    return _counted(diagnostics).groupBy(key).agg(*totals)


def handle_totals(diagnostics: DataFrame, handles: DataFrame) -> DataFrame:
    """Execution totals seen from every handle subscribed to it."""
    return handles.select("handle_id", "execution_id").join(
        diagnostic_totals(diagnostics), "execution_id"
    )


_IDENTITY = ["severity", "code", "message", "context"]


def visible_diagnostics(
    diagnostics: DataFrame, key: str = "execution_id", n: int = VISIBLE_DIAGNOSTICS
) -> DataFrame:
    """The first n distinct diagnostics of each run, with the count each first showed."""
    first = (
        _counted(diagnostics)
        .groupBy(key, *_IDENTITY)
        .agg(
            F.min("position").alias("first_position"),
            F.min_by("count", "position").alias("shown_count"),
        )
    )
    return ordered.top_n(first, [key], [F.col("first_position").asc()], n)


def suppressed_diagnostics(
    diagnostics: DataFrame, key: str = "execution_id", n: int = VISIBLE_DIAGNOSTICS
) -> DataFrame:
    """Occurrences beyond the visible view; repeats of a visible one count as suppressed."""
    total = _counted(diagnostics).groupBy(key, "severity").agg(F.sum("count").alias("total"))
    shown = (
        visible_diagnostics(diagnostics, key, n)
        .groupBy(key, "severity")
        .agg(F.sum("shown_count").alias("shown"))
    )
    return (
        total.join(shown, [key, "severity"], "left")
        .withColumn("shown", F.coalesce("shown", F.lit(0)))
        .withColumn("suppressed", F.col("total") - F.col("shown"))
    )


def line_text(record_type: Column, severity: Column, code: Column, message: Column, count: Column):
    """The rendered text of a log record."""
    repeat = F.when(count > 1, F.concat(F.lit(" (×"), count.cast("string"), F.lit(")")))
    plain = F.coalesce(message, F.lit(""))
    return F.when(
        record_type == "task.diagnostic",
        F.concat(
            F.lit("["), F.coalesce(severity, F.lit("info")), F.lit("] "),
            F.coalesce(code, F.lit("")), F.lit(": "), plain, F.coalesce(repeat, F.lit("")),
        ),
    ).otherwise(plain)


def collapse_lines(
    lines: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    value: list[str],
    time: str,
) -> DataFrame:
    """Consecutive equal lines become one row with a count and the first timestamp."""
    return (
        ordered.runs(lines, keys, order, bucket, value)
        .groupBy(*keys, "run", *value)
        .agg(F.min(time).alias("first_time"), F.count("*").alias("count"))
    )


def timeline(
    tasks: DataFrame, now: float, window: float = 24 * 3600.0, at: str = "created_at"
) -> DataFrame:
    """Tasks of the trailing window with their position x in it, oldest first."""
    start = now - window
    return (
        tasks.where((F.col(at) >= start) & (F.col(at) <= now))
        .withColumn("x", (F.col(at) - F.lit(start)) / F.lit(float(window)))
        .orderBy("x")
    )


def eta(elapsed: Column, current: Column, total: Column) -> Column:
    return F.when(
        (current > 0) & (current < total), F.greatest(elapsed, F.lit(0.0)) * (total - current) / current
    )


def resolve_prefixes(operands: DataFrame, ids: DataFrame) -> DataFrame:
    """operand to id: an exact id beats a unique prefix of at least eight characters.

    A prefix stands for the interval of ids from itself up to its successor, so the next two ids
    in order tell all: none, one or several of them begin with it. Operands and ids are sorted
    together within their first eight characters, which a usable prefix shares with its ids, and
    the next four; the first ids of the buckets behind are carried over to the one before.
    """
    asked = operands.select("operand").distinct()
    both = asked.select(F.col("operand").alias("_key"), F.lit(0).alias("_kind")).unionByName(
        ids.select(F.col("id").alias("_key")).where(F.col("id").isNotNull()).distinct().withColumn("_kind", F.lit(1))
    )
    rows = both.withColumns({"_head": F.substring("_key", 1, MIN_PREFIX), "_bucket": F.substring("_key", MIN_PREFIX + 1, 4)})
    backwards = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = backwards("_head", "_bucket").orderBy(F.desc("_key"), F.desc("_kind"))
    is_id = F.col("_kind") == 1
    behind = rows.withColumn("_next", F.last(F.when(is_id, F.col("_key")), True).over(inside))
    pair = F.struct(F.col("_key").alias("a"), F.col("_next").alias("b"))
    local = behind.withColumn("_two", F.last(F.when(is_id, pair), True).over(inside))

    along = backwards("_head").orderBy(F.desc("_bucket"))
    heads = (
        behind.groupBy("_head", "_bucket")
        .agg(F.min(F.when(is_id, pair)).alias("_p"))
        .withColumn("_later", F.last(F.col("_p.a"), True).over(along))
        .withColumn("_q", F.when(F.col("_p").isNotNull(), F.struct("_p.a", F.coalesce("_p.b", "_later").alias("b"))))
        .select("_head", "_bucket", F.last("_q", True).over(along).alias("_carried"))
    )
    found = (
        local.where(~is_id)
        .join(heads, ["_head", "_bucket"])
        .select(
            F.col("_key").alias("operand"),
            F.coalesce("_two.a", "_carried.a").alias("_first"),
            F.when(F.col("_two").isNull(), F.col("_carried.b")).otherwise(F.coalesce("_two.b", "_carried.a")).alias("_second"),
        )
    )
    operand = F.col("operand")
    begins = lambda c: F.coalesce(F.col(c).startswith(operand), F.lit(False))
    status = (
        F.when(~F.coalesce(operand.rlike("^[0-9a-f]+$"), F.lit(False)), "invalid")
        .when(F.col("_first") == operand, "exact")
        .when(F.length("operand") < MIN_PREFIX, "too short")
        .when(~begins("_first"), "not found")
        .when(begins("_second"), "ambiguous")
        .otherwise("prefix")
    )
    # null operands have no head to meet in
    none = asked.where(operand.isNull()).select("operand", F.lit("invalid").alias("status"), F.lit(None).cast("string").alias("id"))
    known = found.withColumn("status", status)
    return known.select("operand", "status", F.when(F.col("status").isin("exact", "prefix"), F.col("_first")).alias("id")).unionByName(none)
