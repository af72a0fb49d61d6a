"""Event-log and task-record queries, published revisions, exports and streams."""

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covspark.operators import coverage as cov
from covspark.operators import logs, status
from covspark.operators.mutate import Mutation
from covspark.session import shared_folder
from covspark.sources import envelope, export, jsonl
from covspark.sources.revisions import Dataset
from covspark.streaming import activity, sinks
from covspark.streaming import coverage as live_coverage
from covspark.streaming import events as live_events
from covspark.streaming import ingest as live_ingest
from oracle_queries import data
from oracle_queries.data import hull_sql
from oracle_queries.registry import register, table

# event log: views acknowledge the event 5 before them, errors are errors, clicks warnings


def _log(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        "ts",
        F.col("value").alias("timestamp"),
        F.when(kind == "view", "acknowledgement").otherwise(kind).alias("kind"),
        F.when(kind == "error", "error").when(kind == "click", "warning").otherwise("info").alias("severity"),
        F.when(kind == "view", (F.col("event_id") - 5).cast("string")).alias("reference"),
    )


_LOG = """l AS (SELECT CAST(event_id AS VARCHAR) AS event_id, ts, value AS timestamp,
  CASE WHEN event_type = 'view' THEN 'acknowledgement' ELSE event_type END AS kind,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN event_type = 'view' THEN CAST(event_id - 5 AS VARCHAR) END AS reference FROM events),
u AS (SELECT event_id, timestamp, kind, severity, event_id IN (SELECT reference FROM l WHERE reference IS NOT NULL)
  AS acknowledged FROM l WHERE kind <> 'acknowledgement')"""


@register(f"""WITH {_LOG} SELECT event_id, timestamp, kind, severity, acknowledged FROM u
WHERE NOT acknowledged AND severity = 'error' AND timestamp >= 10.0""")
def unread_events(spark, sf):
    """Unread errors since a time, newest first."""
    found = logs.list_events(_log(spark, sf), unread=True, since=10.0, severity="error")
    return found.select("event_id", "timestamp", "kind", "severity", "acknowledged")


@register(f"""WITH {_LOG} SELECT severity, acknowledged, CAST(count(*) AS BIGINT) AS events FROM u GROUP BY 1, 2""")
def acknowledged_events(spark, sf):
    return logs.acknowledged(_log(spark, sf)).groupBy("severity", "acknowledged").agg(
        F.count("*").alias("events")
    )


@register("""
SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_time, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)
      THEN 1 ELSE 0 END AS brk FROM events)) GROUP BY user_id, run, event_type""")
def log_runs(spark, sf):
    """Consecutive equal lines of a log collapse into one with a count."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return logs.collapse_lines(
        e, ["user_id"], ["ts", "event_id"], activity.elapsed("DAY", "ts"), ["event_type"], "ts"
    ).drop("run")


# task records: orders are handles, priorities datasets, customers executions


def _handles(spark, sf):
    o = table(spark, sf, "orders")
    state = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("handle_id"),
        F.col("o_custkey").alias("execution_id"),
        F.col("o_orderpriority").alias("dataset"),
        F.when(state == "F", "succeeded").when(state == "O", "failed").otherwise("queued").alias("status"),
        F.unix_date(F.to_date("o_orderdate")).cast("double").alias("created_at"),
        F.col("o_totalprice").alias("updated_at"),
    )


_HANDLES = """h AS (SELECT o_orderkey AS handle_id, o_custkey AS execution_id, o_orderpriority AS dataset,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'queued' END AS status,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS created_at,
  o_totalprice AS updated_at FROM orders)"""
_KEPT = """kept AS (SELECT * FROM h WHERE status = 'queued' UNION ALL SELECT * FROM (SELECT * FROM h WHERE
  status <> 'queued' QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY updated_at DESC, handle_id) <= 1000))"""


@register(f"""WITH {_HANDLES} SELECT dataset, handle_id, execution_id, status, created_at, updated_at FROM h
WHERE status IN ('succeeded', 'failed') QUALIFY row_number() OVER
  (PARTITION BY dataset ORDER BY updated_at DESC, handle_id) = 1""")
def newest_per_group(spark, sf):
    """The newest finished task of each dataset."""
    return logs.newest_terminal(_handles(spark, sf))


@register(f"""WITH {_HANDLES}, {_KEPT} SELECT handle_id, dataset, status FROM kept""")
def retain_top_n(spark, sf):
    """Unfinished tasks and the newest 1000 finished ones per dataset."""
    return logs.retained(_handles(spark, sf)).select("handle_id", "dataset", "status")


@register(f"""WITH {_HANDLES}, {_KEPT} SELECT c_custkey AS execution_id FROM customer
WHERE c_custkey IN (SELECT execution_id FROM kept)""")
def retained_executions(spark, sf):
    executions = table(spark, sf, "customer").select(F.col("c_custkey").alias("execution_id"))
    return logs.retained_executions(executions, logs.retained(_handles(spark, sf)))


@register(f"""WITH {_HANDLES} SELECT c_custkey AS execution_id, CAST(count(handle_id) AS BIGINT) AS subscribers
FROM customer LEFT JOIN h ON execution_id = c_custkey AND status = 'queued' GROUP BY c_custkey""")
def subscribers(spark, sf):
    executions = table(spark, sf, "customer").select(F.col("c_custkey").alias("execution_id"))
    return logs.subscribers(_handles(spark, sf), executions)


@register(f"""WITH {_HANDLES} SELECT dataset, CAST(count(*) FILTER (status = 'queued') AS BIGINT) AS queued,
  CAST(count(*) FILTER (status = 'failed' AND handle_id % 4 < 3) AS BIGINT) AS running FROM h GROUP BY dataset""")
def queue_lengths(spark, sf):
    """Waiting and working tasks per dataset; of the failed ones some are still at it."""
    again = F.element_at(F.array(*map(F.lit, (*logs.RUNNING, "failed"))), F.least(F.col("handle_id") % 4, F.lit(len(logs.RUNNING))).cast("int") + 1)
    tasks = _handles(spark, sf).withColumn("status", F.when(F.col("status") == "failed", again).otherwise(F.col("status")))
    return logs.queue_lengths(tasks)


@register(f"""WITH {_HANDLES} SELECT handle_id, created_at, (created_at - 10000.0) / 365.0 AS x FROM h
WHERE created_at >= 10000.0 AND created_at <= 10365.0""")
def activity_timeline(spark, sf):
    """Tasks of the trailing window with their place in it."""
    return logs.timeline(_handles(spark, sf), 10365.0, 365.0).select("handle_id", "created_at", "x")


@register("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber > 0 AND l_linenumber < 7
  THEN l_quantity * (7 - l_linenumber) / l_linenumber END AS eta FROM lineitem""")
def progress_eta(spark, sf):
    """Remaining time from elapsed time and progress."""
    rows = table(spark, sf, "lineitem")
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        logs.eta(F.col("l_quantity"), F.col("l_linenumber"), F.lit(7)).alias("eta"),
    )


# diagnostics: one per event, runs are users


def _diagnostics(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("execution_id"),
        F.col("event_id").alias("position"),
        F.when(kind == "error", "error").when(kind == "signup", "info").otherwise("warning").alias("severity"),
        kind.alias("code"),
        F.floor("value").cast("string").alias("message"),
        F.lit(None).cast("string").alias("context"),
        (F.floor("value").cast("bigint") % 4).alias("count"),
    )


_DIAG = """d AS (SELECT user_id AS execution_id, event_id AS position, CASE event_type WHEN 'error' THEN 'error'
  ELSE 'warning' END AS severity, event_type AS code, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS message,
  CAST(floor(value) AS BIGINT) % 4 AS count FROM events
  WHERE event_type <> 'signup' AND CAST(floor(value) AS BIGINT) % 4 >= 1),
v AS (SELECT execution_id, severity, code, message, min(position) AS first_position, arg_min(count, position) AS shown_count
  FROM d GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY min(position)) <= 10)"""


@register(f"""WITH {_DIAG} SELECT execution_id, severity, code, message, first_position,
  CAST(shown_count AS BIGINT) AS shown_count, CAST(row_number() OVER (PARTITION BY execution_id ORDER BY first_position)
  AS INTEGER) AS rank FROM v""")
def diagnostics_top10(spark, sf):
    """The first ten distinct diagnostics of each run."""
    return logs.visible_diagnostics(_diagnostics(spark, sf)).drop("context")


@register(f"""WITH {_DIAG}, t AS (SELECT execution_id, severity, sum(count) AS total FROM d GROUP BY 1, 2),
s AS (SELECT execution_id, severity, sum(shown_count) AS shown FROM v GROUP BY 1, 2)
SELECT execution_id, severity, CAST(total AS BIGINT) AS total, CAST(coalesce(shown, 0) AS BIGINT) AS shown,
  CAST(total - coalesce(shown, 0) AS BIGINT) AS suppressed FROM t LEFT JOIN s USING (execution_id, severity)""")
def diagnostics_suppressed(spark, sf):
    return logs.suppressed_diagnostics(_diagnostics(spark, sf))


@register(f"""WITH {_DIAG} SELECT execution_id, CAST(coalesce(sum(count) FILTER (severity = 'warning'), 0) AS BIGINT)
  AS warnings, CAST(coalesce(sum(count) FILTER (severity = 'error'), 0) AS BIGINT) AS errors FROM d GROUP BY execution_id""")
def event_severity_counts(spark, sf):
    """Weighted diagnostic totals per run."""
    return logs.diagnostic_totals(_diagnostics(spark, sf))


# id prefixes: ids are md5 of order keys, operands are cut from them


_ID = """CASE WHEN o_orderpriority = '2-HIGH' THEN concat(substring(md5(CAST(o_custkey AS VARCHAR)), 1, 8),
  substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 24)) ELSE md5(CAST(o_orderkey AS VARCHAR)) END"""
_OPERAND = """CASE WHEN o_orderpriority = '1-URGENT' THEN id WHEN o_orderpriority = '2-HIGH' THEN substring(id, 1, 8)
  WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 3 = 0 THEN substring(md5(concat('x', CAST(o_orderkey AS VARCHAR))), 1, 10)
  WHEN o_orderpriority = '3-MEDIUM' THEN substring(id, 1, 12)
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN substring(id, 1, 5) ELSE upper(id) END"""


@register(f"""
WITH i AS (SELECT {_ID} AS id, * FROM orders), o AS (SELECT DISTINCT {_OPERAND} AS operand FROM i),
d AS (SELECT DISTINCT id FROM i),
m AS (SELECT substring(id, 1, n) AS operand, count(*) AS n, min(id) AS id FROM d, (VALUES (8), (10), (12)) AS l(n) GROUP BY 1),
s AS (SELECT operand, CASE WHEN NOT regexp_full_match(operand, '[0-9a-f]+') THEN 'invalid'
  WHEN length(operand) = 32 THEN 'exact' WHEN length(operand) < 8 THEN 'too short' WHEN n > 1 THEN 'ambiguous'
  WHEN n IS NULL THEN 'not found' ELSE 'prefix' END AS status, m.id FROM o LEFT JOIN m USING (operand))
SELECT operand, status, CASE status WHEN 'exact' THEN operand WHEN 'prefix' THEN id END AS id FROM s""")
def resolve_prefixes(spark, sf):
    """Operands to ids: exact beats a unique prefix of eight characters or more; some are shared, some nobody's."""
    orders = table(spark, sf, "orders")
    known = orders.withColumn("id", F.expr(_ID.replace("VARCHAR", "STRING")))
    return logs.resolve_prefixes(known.select(F.expr(_OPERAND.replace("VARCHAR", "STRING")).alias("operand")), known.select("id"))


# activity


@register("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS bucket_start, event_type,
  CAST(count(*) AS BIGINT) AS events FROM events GROUP BY date_trunc('hour', ts), event_type""")
def activity_window(spark, sf):
    return activity.per_bucket(table(spark, sf, "events"), "ts", "1 hour", "event_type")


_BURSTS = """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last,
  CAST(count(*) AS BIGINT) AS events FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOUR
      THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, run"""


@register(_BURSTS)
def activity_bursts(spark, sf):
    """Bursts of activity per user, with pauses of at most four hours."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return activity.finished_bursts(e, "ts", "user_id", ["ts", "event_id"], 4 * 3600)


@register("""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, ts + INTERVAL 8 HOUR AS t FROM events)
SELECT event_id, CASE WHEN d < CAST(t AS DATE) THEN 'after-window' WHEN hour(t) < 15 THEN 'before-window'
  WHEN hour(t) < 17 THEN 'inside-window' ELSE 'after-window' END AS arrival FROM e""")
def arrival_class(spark, sf):
    """Rows classified by their arrival against the publication window of their day."""
    rows = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), "ts")
    return activity.arrival_class(rows, "day", "ts").select("event_id", "arrival")


# published revisions and exports


def _published(spark, sf) -> Dataset:
    """Events published in three revisions: all, one range replacement, one upsert."""
    root = shared_folder(spark, "published")
    dataset = Dataset(spark, root, data.EVENT_DAYS)
    base = data.event_days(spark, sf)
    held = data.hull(spark, sf)
    dataset.publish([Mutation.complete(base)], held)
    bought = base.where("event_type = 'purchase'").withColumn("value", F.col("value") + 1000)
    dataset.publish([Mutation.ranges(bought, data.hull(spark, sf, "purchase"))], held)
    errors = base.where("event_type = 'error'").withColumn("value", -F.col("value"))
    dataset.publish([Mutation.primary_keys(errors)], held)
    return dataset


_PUBLISHED = f"""base AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day, event_id, event_type, value
  FROM events), s AS ({hull_sql('purchase')}),
t AS (SELECT * FROM base WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM s WHERE s.key = base.user_id
    AND base.day >= s.start AND base.day < s."end")
  UNION ALL SELECT user_id, day, event_id, event_type, value + 1000 FROM base WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, day, event_id, event_type, -value FROM base WHERE event_type = 'error')"""


@register(f"""WITH {_PUBLISHED} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM t
WHERE day >= DATE '2024-01-08' AND day < DATE '2024-01-15' AND event_type IN ('purchase', 'error')""")
def published_query(spark, sf):
    """Three publications, then a query on the pinned revision."""
    dataset = _published(spark, sf)
    return dataset.query(
        time_range=(date(2024, 1, 8), date(2024, 1, 15)),
        filters=[("event_type", "in", ["purchase", "error"])],
        order_by=["user_id", "day", "event_id"],
    )


@register(f"""WITH {_PUBLISHED} SELECT event_type, CAST(count(*) AS BIGINT) AS events, max(value) AS top FROM t GROUP BY 1""")
def published_sql(spark, sf):
    """Guarded SQL on a published revision."""
    return _published(spark, sf).sql(
        "SELECT event_type, count(*) AS events, max(value) AS top FROM data GROUP BY event_type"
    )


@register(f"""WITH {_PUBLISHED} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM t""")
def published_snapshot(spark, sf):
    """A snapshot copy read back."""
    dataset = _published(spark, sf)
    there = dataset.export_snapshot(shared_folder(spark, "snapshot"))
    return spark.read.parquet(f"{there}/data")


@register(f"""WITH {_PUBLISHED} SELECT CAST(3 AS BIGINT) AS revision, 'ready' AS state,
  CAST((SELECT count(DISTINCT user_id) FROM base) AS BIGINT) AS covered_keys,
  CAST((SELECT min(day) FROM base) AS VARCHAR) AS covered_start, CAST((SELECT max(day) + 1 FROM base) AS VARCHAR) AS covered_end,
  CAST((SELECT count(*) FROM base) + (SELECT count(*) FROM t0) + (SELECT count(*) FROM t) AS BIGINT) AS rows_written
FROM (SELECT 1)""".replace("WITH base", "WITH t0 AS (SELECT user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM ("
  + hull_sql("purchase") + ") s WHERE s.key = CAST(events.user_id AS VARCHAR) AND CAST(ts AS DATE) >= s.start AND "
  "CAST(ts AS DATE) < s.\"end\") UNION ALL SELECT user_id FROM events WHERE event_type = 'purchase'), base"))
def published_status(spark, sf):
    """State and coverage summary after three publications, and the rows they wrote."""
    dataset = _published(spark, sf)
    found = status.summary(dataset)
    return dataset.history().agg(
        F.max("revision").alias("revision"), F.sum("rows_written").alias("rows_written")
    ).select(
        "revision",
        F.lit(found["state"]).alias("state"),
        F.lit(found["covered_keys"]).cast("bigint").alias("covered_keys"),
        F.lit(found["covered_start"]).alias("covered_start"),
        F.lit(found["covered_end"]).alias("covered_end"),
        "rows_written",
    )


@register(f"""WITH r AS ({hull_sql()}), c AS ({hull_sql('purchase')}),
j AS (SELECT r.key, r.start AS s, r."end" AS e, c.start AS cs, c."end" AS ce FROM r LEFT JOIN c ON r.key = c.key)
SELECT key, CAST(s AS VARCHAR) AS work_start, CAST(coalesce(cs, e) AS VARCHAR) AS work_end FROM j WHERE cs IS NULL OR s < cs
UNION ALL SELECT key, CAST(ce AS VARCHAR), CAST(e AS VARCHAR) FROM j WHERE e > ce""")
def resume_work(spark, sf):
    """After a partial publication a rerun asks only for what committed coverage lacks."""
    dataset = Dataset(spark, shared_folder(spark, "resume"), data.EVENT_DAYS)
    bought = data.event_days(spark, sf).where("event_type = 'purchase'")
    dataset.publish([Mutation.complete(bought)], data.hull(spark, sf, "purchase"))
    todo = cov.continuity_gaps(data.hull(spark, sf), dataset.coverage())
    return todo.select("key", "work_start", "work_end")


_EXPORTED = """SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  nullif(event_type, 'error') AS event_type, value FROM events"""


def _exported(spark, sf, kind):
    rows = data.events(spark, sf).withColumn("event_type", F.nullif("event_type", F.lit("error")))
    path = shared_folder(spark, f"export-{kind}")
    spark._jvm.org.apache.hadoop.fs.Path(path).getParent().getFileSystem(
        spark._jsc.hadoopConfiguration()
    ).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path).getParent())
    export.write(rows, path, kind)
    return path, rows.schema


@register(_EXPORTED)
def export_csv(spark, sf):
    path, schema = _exported(spark, sf, "csv")
    return spark.read.schema(schema).option("header", True).csv(path)


@register(_EXPORTED)
def export_parquet(spark, sf):
    path, _ = _exported(spark, sf, "parquet")
    return spark.read.parquet(path)


@register(_EXPORTED)
def export_jsonl(spark, sf):
    path, schema = _exported(spark, sf, "jsonl")
    return jsonl.read(spark, path, schema)


@register(_EXPORTED)
def export_arrow(spark, sf):
    path, schema = _exported(spark, sf, "arrow")
    return export.read_arrow(spark, path, schema)


@register("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(event_id) AS BIGINT) AS result FROM events""")
def consume_batches(spark, sf):
    """Arrow batches consumed on executors."""
    rows = data.events(spark, sf)
    done = export.for_each_batch(
        rows, lambda batch: sum(batch.column("event_id").to_pylist()), batch_size=1000
    )
    return done.agg(F.sum("rows").alias("rows"), F.sum("result").alias("result"))


@register("""SELECT event_id, event_type IN ('error', 'view') AS skipped, CASE WHEN event_type NOT IN ('error', 'view')
  THEN event_type END AS message FROM events""")
def jsonl_lines(spark, sf):
    """Log lines where some are cut off and some are no objects: those are skipped and counted."""
    kind = F.col("event_type")
    line = F.to_json(F.struct(kind.alias("message"), F.col("value").alias("time")))
    text = F.when(kind == "error", F.expr("substring(l, 1, length(l) - 1)")).when(
        kind == "view", F.concat(F.lit("["), F.col("l"), F.lit("]"))
    ).otherwise(F.col("l"))
    lines = table(spark, sf, "events").withColumn("l", line).select("event_id", text.alias("value"))
    return jsonl.parse(lines, "message string, time double").select(
        "event_id", "skipped", F.col("record.message").alias("message")
    )


@register("""SELECT event_id, event_type AS message, CASE WHEN event_type <> 'view' THEN CAST(1.5 AS DOUBLE) END AS time
FROM events WHERE event_type <> 'error'""")
def jsonl_read_lines(spark, sf):
    """A log file read back: cut lines are skipped, a field of another type is null."""
    kind = F.col("event_type")
    day = F.when(kind == "view", F.lit('"none"')).otherwise(F.lit("1.5"))
    line = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"message":"'), kind, F.lit('","time":'), day, F.lit("}"))
    text = F.when(kind == "error", F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    path = shared_folder(spark, "lines")
    table(spark, sf, "events").select(text.alias("value")).write.text(path)
    return jsonl.read(spark, path, "event_id long, message string, time double")


# streams


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@register("""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS d, ts + INTERVAL 8 HOUR AS t FROM events),
a AS (SELECT d, CASE WHEN d < CAST(t AS DATE) THEN 'after-window' WHEN hour(t) < 15 THEN 'before-window'
  WHEN hour(t) < 17 THEN 'inside-window' ELSE 'after-window' END AS arrival FROM e)
SELECT CAST(d AS VARCHAR) AS day, arrival, CAST(count(*) AS BIGINT) AS events FROM a GROUP BY 1, 2""")
def stream_arrivals(spark, sf):
    """Arrivals per day against its publication window, counted over a stream."""
    rows = _stream(spark, sf).select(F.to_date("ts").alias("day"), "ts")
    stream = (
        activity.arrival_class(rows, "day", "ts")
        .groupBy("day", "arrival")
        .agg(F.count("*").alias("events"))
    )
    return _current(spark, stream, ["day", "arrival"])


def _current(spark, stream, keys):
    path, checkpoint = shared_folder(spark, "stream"), shared_folder(spark, "state")
    sinks.upsert_batches(stream, path, checkpoint, keys).awaitTermination()
    return sinks.current(spark, path, stream.schema)


@register("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS bucket_start,
  CAST(count(*) AS BIGINT) AS events FROM events GROUP BY date_trunc('hour', ts)""")
def stream_activity(spark, sf):
    """Hourly counts from a stream of event files."""
    stream = activity.per_bucket(_stream(spark, sf), "ts", "1 hour", delay="1 hour")
    return _current(spark, stream, ["bucket_start"])


@register(_BURSTS)
def stream_bursts(spark, sf):
    """The same bursts from a stream in which every second event arrives a batch late."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    folder, path, state = (shared_folder(spark, x) for x in ("landed", "stream", "state"))
    for late in (1, 0):
        e.where(F.col("event_id") % 2 == late).write.mode("append").parquet(folder)
        landed = spark.readStream.schema(e.schema).parquet(folder)
        activity.follow_bursts(landed, "ts", "user_id", 4 * 3600, path, state).awaitTermination()
    schema = activity.cells(e, "ts", "user_id", 4 * 3600).schema
    return activity.read_bursts(spark, path, schema, "user_id", 4 * 3600)


@register("""SELECT CAST(user_id AS VARCHAR) AS key, CAST(min(d) AS VARCHAR) AS start, CAST(max(d) + 1 AS VARCHAR) AS "end",
  CAST(count(*) AS BIGINT) AS days, count(*) <> max(d) - min(d) + 1 AS has_gap
FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) GROUP BY user_id""")
def stream_coverage(spark, sf):
    """Running coverage and gap flag per user from a stream."""
    facts = _stream(spark, sf).select("user_id", F.to_date("ts").alias("day"))
    path = shared_folder(spark, "stream")
    live_coverage.follow(facts, "user_id", "day", path, shared_folder(spark, "state")).awaitTermination()
    return live_coverage.read(spark, path)


@register(f"""WITH {_LOG} SELECT severity, CAST(count(*) AS BIGINT) AS unread FROM u WHERE NOT acknowledged GROUP BY 1""")
def stream_unread(spark, sf):
    """Unread counts per severity, acknowledgements arriving later in the same stream."""
    e = _stream(spark, sf)
    kind = F.col("event_type")
    log = e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(kind == "view", "acknowledgement").otherwise(kind).alias("kind"),
        F.when(kind == "error", "error").when(kind == "click", "warning").otherwise("info").alias("severity"),
        F.when(kind == "view", (F.col("event_id") - 5).cast("string")).alias("reference"),
    )
    path = shared_folder(spark, "stream")
    live_events.follow(log, path, shared_folder(spark, "state")).awaitTermination()
    return live_events.unread(spark, path).groupBy("severity").agg(F.count("*").alias("unread"))


def _answers(spark, sf, arrival: int, value="value", asked="user_id"):
    """One answer per user and day over all events; a busy user's day has several parts."""
    names = data.EVENT_DAYS.columns
    item = F.array(
        "user_id", F.date_format("day", "yyyyMMdd"), F.col("event_id").cast("string"), "event_type",
        F.expr(value).cast("string"),
    )
    body = F.struct(
        F.lit(0).alias("code"),
        F.struct(F.array(*[F.lit(n) for n in names]).alias("fields"), "items").alias("data"),
    )
    request = Window.partitionBy("key", "start")
    return (
        data.event_days(spark, sf)
        .groupBy(F.expr(asked).alias("key"), F.col("day").alias("start"), F.floor(F.col("event_id") / 1000).cast("int").alias("part"))
        .agg(F.collect_list(item).alias("items"))
        .select(
            F.concat_ws("/", "key", "start", F.lit(arrival)).alias("request_id"),
            "key",
            "start",
            F.date_add("start", 1).alias("end"),
            F.lit(arrival).cast("bigint").alias("arrival"),
            "part",
            F.count("*").over(request).cast("int").alias("parts"),
            F.to_json(body).alias("response"),
        )
    )


def _stream_landed(spark, dataset, folder, state):
    now = datetime(2024, 3, 1, 12, 0, tzinfo=ZoneInfo("Asia/Shanghai"))
    live_ingest.start(
        live_ingest.read_landed(spark, folder), dataset, state, "events", lambda: now, "hull", unused=f"{state}-unused"
    ).awaitTermination()
    return dataset.refresh()


_ALL_EVENTS = """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, event_type, value
FROM events"""


@register(_ALL_EVENTS)
def stream_ingest(spark, sf):
    """Landed responses, one or more parts per user and day, published by a stream and read from the revision."""
    folder = shared_folder(spark, "landed")
    _answers(spark, sf, 1).write.json(folder)
    dataset = Dataset(spark, shared_folder(spark, "ingested"), data.EVENT_DAYS)
    return _stream_landed(spark, dataset, folder, shared_folder(spark, "state")).scan()


@register(_ALL_EVENTS)
def stream_ingest_repeated(spark, sf):
    """Answers of arrival 9, then 10 in parts over two batches, and 2 last of all: 10 stays, though "9" and "2" are larger as text."""
    folder, state = shared_folder(spark, "landed"), shared_folder(spark, "state")
    dataset = Dataset(spark, shared_folder(spark, "ingested"), data.EVENT_DAYS)
    old, newest = _answers(spark, sf, 9, "value + 1"), _answers(spark, sf, 10)
    stale = _answers(spark, sf, 2, "value - 1").where("part % 3 = 0").withColumn("parts", F.lit(1))
    first = F.col("part") % 2 == 0
    old.unionByName(newest.where(first)).write.mode("append").json(folder)
    _stream_landed(spark, dataset, folder, state)
    newest.where(~first).unionByName(stale).write.mode("append").json(folder)
    return _stream_landed(spark, dataset, folder, state).scan()


@register("""SELECT CAST(user_id + 1 AS VARCHAR) || '/' || CAST(ts AS DATE) || '/1' AS request_id, CAST(user_id AS VARCHAR) AS user_id,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id FROM events WHERE event_id % 50 = 0""")
def foreign_key_refused(spark, sf):
    """Rows of another key than their own request's, though other requests ask for that key."""
    landed = _answers(spark, sf, 1, asked="IF(event_id % 50 = 0, CAST(CAST(user_id AS BIGINT) + 1 AS STRING), user_id)")
    staged = live_ingest.staged_rows(envelope.classify(live_ingest.newest_answers(landed)), data.EVENT_DAYS)
    return live_ingest.foreign_rows(staged, data.EVENT_DAYS).select("request_id", "user_id", "day", "event_id")
