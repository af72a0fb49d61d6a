"""Queries, guarded SQL, validation, coverage and calendar."""

from datetime import date

from pyspark.sql import functions as F

from covspark.errors import CoverageError
from covspark.functions import dates
from covspark.operators import calendar as cal
from covspark.operators import coverage as cov
from covspark.operators import query as relation
from covspark.operators import sql as guarded
from covspark.operators import status, validate
from covspark.spec import fields, DatasetSpec
from oracle_queries import data
from oracle_queries.data import CALENDAR_SQL, DAYS_SQL, EVENTS_SQL, USERS_SQL, hull_sql
from oracle_queries.registry import register, table

RANGE = (date(2024, 1, 5), date(2024, 1, 25))
WEEK = (date(2024, 1, 8), date(2024, 1, 15))


@register(f"""
SELECT event_id, user_id, CAST(day AS VARCHAR) AS day, value FROM ({EVENTS_SQL})
WHERE user_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND day >= DATE '2024-01-08'
  AND day < DATE '2024-01-15' AND event_type != 'error' AND value >= 5.0
ORDER BY value DESC, event_id LIMIT 100""")
def query_literal_keys(spark, sf):
    """Keys, half-open range, projection, comparisons, order and limit."""
    return relation.query(
        data.events(spark, sf, WEEK),
        data.EVENTS,
        keys=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89],
        time_range=WEEK,
        columns=["event_id", "user_id", "day", "value"],
        filters=[("event_type", "!=", "error"), ("value", ">=", 5.0)],
        order_by=[("value", "desc"), "event_id"],
        limit=100,
    )


@register(f"""
WITH held AS ({hull_sql()})
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(day AS VARCHAR) AS day, value FROM ({EVENTS_SQL})
WHERE CAST(user_id AS VARCHAR) IN (SELECT key FROM held WHERE start <= DATE '2024-01-08' AND "end" >= DATE '2024-01-15')
  AND day >= DATE '2024-01-08' AND day < DATE '2024-01-15' AND event_type != 'error' AND value >= 5.0
ORDER BY value DESC, event_id LIMIT 100""")
def query_keys_range(spark, sf):
    """The flagship: every user covered for the week, with coverage required and checked."""
    held = data.hull(spark, sf)
    whole_week = held.where((F.col("start") <= F.lit(WEEK[0])) & (F.col("end") >= F.lit(WEEK[1])))
    return relation.query(
        data.event_days(spark, sf, WEEK),
        data.EVENT_DAYS,
        keys=whole_week.select("key"),
        time_range=WEEK,
        columns=["event_id", "user_id", "day", "value"],
        filters=[("event_type", "!=", "error"), ("value", ">=", 5.0)],
        order_by=[("value", "desc"), "event_id"],
        limit=100,
        coverage=held,
        require_coverage=True,
    )


@register("""
SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND nullif(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH')
  AND o_totalprice < 400000.0""")
def query_in_notin_nulls(spark, sf):
    """in / not in over a column with nulls: null cells match neither."""
    rows = data.orders(spark, sf).withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))
    )
    return relation.query(
        rows,
        data.ORDERS,
        columns=["o_orderkey", "o_orderpriority", "o_totalprice"],
        filters=[
            ("o_orderstatus", "in", ["F", "O"]),
            ("o_orderpriority", "not in", ["1-URGENT", "2-HIGH"]),
            ("o_totalprice", "<", 400000.0),
        ],
    )


@register("""
WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey = 1 THEN o_orderpriority END AS vip FROM orders)
SELECT * FROM (SELECT 'asc' AS direction, o_orderkey, vip FROM t
  ORDER BY vip ASC NULLS LAST, o_orderkey LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'desc', o_orderkey, vip FROM t
  ORDER BY vip DESC NULLS LAST, o_orderkey LIMIT 100)""")
def query_order_nulls_last(spark, sf):
    """Nulls come last in both directions."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") == 1, F.col("o_orderpriority")).alias("vip")
    )
    spec = DatasetSpec("driver/vip", fields("o_orderkey long!, vip string"), ("o_orderkey",))
    asc, desc = (
        relation.query(rows, spec, order_by=[("vip", way), "o_orderkey"], limit=100).select(
            F.lit(way).alias("direction"), "o_orderkey", "vip"
        )
        for way in ("asc", "desc")
    )
    return asc.union(desc)


@register("""
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS o_orderdate FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'""")
def query_key_table(spark, sf):
    """A key set too large for a literal list: a semi-join picks it up."""
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("key")
    )
    return relation.query(
        data.orders(spark, sf, ("1996-01-01", "1997-01-01")),
        data.ORDERS,
        keys=keys,
        time_range=("1996-01-01", "1997-01-01"),
        columns=["o_orderkey", "o_custkey", "o_orderdate"],
    )


@register(f"""
SELECT event_id, user_id, CAST(day AS VARCHAR) AS day, event_type, value FROM ({EVENTS_SQL})
WHERE user_id IN (7, 11) AND day >= DATE '2024-01-08' AND day < DATE '2024-01-15'
ORDER BY event_id LIMIT 20""")
def preview_rows(spark, sf):
    """Preview: primary-key order, twenty rows, partial coverage allowed."""
    return relation.preview(
        data.events(spark, sf, WEEK), data.EVENTS, keys=[7, 11], time_range=WEEK, allow_partial=True
    )


@register("""
SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS orders, max(o_totalprice) AS top
FROM orders WHERE o_orderpriority <> 'select; --' GROUP BY o_orderstatus, o_orderpriority
HAVING count(*) > 1""")
def sql_guarded_groupby(spark, sf):
    """Guarded SQL with keywords inside a literal, grouping and HAVING."""
    return guarded.run(
        data.orders(spark, sf),
        "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, max(o_totalprice) AS top "
        "FROM data WHERE o_orderpriority <> 'select; --' "
        "GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 1",
    )


@register("""
SELECT o_orderkey, o_custkey, CAST(row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders""")
def sql_guarded_window(spark, sf):
    return guarded.run(
        data.orders(spark, sf),
        "SELECT o_orderkey, o_custkey, row_number() OVER "
        "(PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM data",
    )


@register("""
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, max(l_quantity) AS top_quantity,
  CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def sql_guarded_cube(spark, sf):
    return guarded.run(
        table(spark, sf, "lineitem"),
        "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS top_quantity, "
        "CAST(grouping_id() AS BIGINT) AS level FROM data GROUP BY CUBE (l_returnflag, l_linestatus)",
    )


@register("""
SELECT upper(o_orderpriority) AS p, CAST(year(o_orderdate) AS BIGINT) AS y,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers
FROM orders GROUP BY ROLLUP (upper(o_orderpriority), year(o_orderdate))""")
def sql_guarded_rollup(spark, sf):
    return guarded.run(
        data.orders(spark, sf),
        "SELECT upper(o_orderpriority) AS p, CAST(year(o_orderdate) AS BIGINT) AS y, "
        "count(DISTINCT o_custkey) AS customers "
        "FROM data GROUP BY ROLLUP (upper(o_orderpriority), year(o_orderdate))",
    )


@register("""
SELECT o_orderkey, lower(o_orderpriority) AS low, substr(o_orderpriority, 3) AS word, length(o_orderpriority) AS size,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, abs(o_custkey - 500) AS away,
  CAST(year(o_orderdate) AS INTEGER) AS y, coalesce(nullif(o_orderstatus, 'P'), 'none') AS state,
  CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS kind, o_orderpriority LIKE '%LOW' AS is_low
FROM orders WHERE o_orderpriority LIKE '%-%' AND o_totalprice BETWEEN 1000 AND 400000""")
def sql_guarded_functions(spark, sf):
    """Scalar functions reachable through guarded SQL."""
    return guarded.run(
        data.orders(spark, sf),
        "SELECT o_orderkey, lower(o_orderpriority) AS low, substr(o_orderpriority, 3) AS word, "
        "CAST(length(o_orderpriority) AS BIGINT) AS size, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, "
        "abs(o_custkey - 500) AS away, year(o_orderdate) AS y, "
        "coalesce(nullif(o_orderstatus, 'P'), 'none') AS state, "
        "CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS kind, "
        "o_orderpriority LIKE '%LOW' AS is_low "
        "FROM data WHERE o_orderpriority LIKE '%-%' AND o_totalprice BETWEEN 1000 AND 400000",
    )


# validation


@register("""
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def pk_duplicates(spark, sf):
    return validate.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER
  (nullif(l_linenumber, 1) IS NULL OR nullif(l_returnflag, 'N') IS NULL) AS BIGINT) AS null_key_rows
FROM lineitem""")
def pk_nulls(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.nullif("l_linenumber", F.lit(1)).alias("a"), F.nullif("l_returnflag", F.lit("N")).alias("b")
    )
    return validate.null_keys(rows, ["a", "b"])


@register("""
SELECT k, n, CAST(count(*) AS BIGINT) AS rows,
  CASE WHEN k IS NULL OR n IS NULL THEN 'null key' ELSE 'duplicate key' END AS problem
FROM (SELECT l_orderkey AS k, nullif(l_linenumber, 1) AS n FROM lineitem)
GROUP BY k, n HAVING k IS NULL OR n IS NULL OR count(*) > 1""")
def key_problems(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.nullif("l_linenumber", F.lit(1)).alias("n")
    )
    return validate.keys(rows, ["k", "n"])


@register("""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'status' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'priority' END) AS missing
FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW'""")
def required_violations(spark, sf):
    """Rows with null required fields and the names of those fields."""
    spec = DatasetSpec(
        "driver/required",
        fields("o_orderkey long!, status string!, priority string!, o_totalprice double"),
        primary_key=("o_orderkey",),
    )
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        "o_totalprice",
    )
    validate.schema(rows, spec)
    return validate.required(rows, spec).select(
        "o_orderkey", F.array_join("missing", ",").alias("missing")
    )


@register(f"""
WITH scopes AS ({hull_sql('purchase')})
SELECT event_id FROM ({EVENTS_SQL}) e WHERE NOT EXISTS (SELECT 1 FROM scopes s
  WHERE s.key = CAST(e.user_id AS VARCHAR) AND e.day >= s.start AND e.day < s."end")""")
def scope_violations(spark, sf):
    """Rows of a range replacement outside every declared key and range."""
    rows = data.event_days(spark, sf)
    return validate.in_scope(rows, data.hull(spark, sf, "purchase"), data.EVENT_DAYS).select("event_id")


@register(f"""
WITH c AS ({hull_sql('click')} UNION ALL
  SELECT CAST(user_id AS VARCHAR), CAST(ts AS DATE), CAST(ts AS DATE) FROM events WHERE event_type = 'signup')
SELECT key, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (key = '' OR start >= "end") AS BIGINT) AS bad_rows FROM c GROUP BY key
HAVING count(*) > 1 OR count(*) FILTER (key = '' OR start >= "end") > 0""")
def coverage_violations(spark, sf):
    empty = data.events(spark, sf).where("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("day").alias("start"),
        F.col("day").alias("end"),
    )
    return validate.coverage(data.hull(spark, sf, "click").unionByName(empty))


# coverage


@register(f"""SELECT key, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end" FROM ({hull_sql()})""")
def coverage_from_facts(spark, sf):
    return cov.read(data.hull(spark, sf))


@register(f"""SELECT CAST(count(*) AS BIGINT) AS keys, CAST(min(start) AS VARCHAR) AS start,
  CAST(max("end") AS VARCHAR) AS "end" FROM ({hull_sql('purchase')})""")
def coverage_summary(spark, sf):
    return cov.summary(data.hull(spark, sf, "purchase"))


_GAPS = f"""
WITH c AS ({hull_sql('signup')}),
r AS (SELECT key, DATE '2024-01-05' AS s, DATE '2024-01-25' AS e FROM ({USERS_SQL})),
j AS (SELECT r.key, s, e, c.start AS cs, c."end" AS ce FROM r LEFT JOIN c ON r.key = c.key),
g AS (SELECT key, s AS a, e AS b, s, e FROM j WHERE cs IS NULL
  UNION ALL SELECT key, s, least(e, cs), s, e FROM j WHERE s < cs AND s < least(e, cs)
  UNION ALL SELECT key, greatest(s, ce), e, s, e FROM j WHERE e > ce AND greatest(s, ce) < e)"""


@register(f"""{_GAPS}
SELECT key, CAST(a AS VARCHAR) AS gap_start, CAST(b AS VARCHAR) AS gap_end FROM g""")
def coverage_gaps(spark, sf):
    requests = cov.requests_for(data.users(spark, sf), *RANGE)
    return cov.gaps(requests, data.hull(spark, sf, "signup")).select("key", "gap_start", "gap_end")


@register(f"""{_GAPS}
SELECT key, CAST(a AS VARCHAR) AS gap_start, CAST(b AS VARCHAR) AS gap_end FROM g""")
def coverage_error_gaps(spark, sf):
    """A read that needs coverage fails with every gap, not with the first few."""
    try:
        cov.enforce(data.EVENT_DAYS, data.hull(spark, sf, "signup"), data.users(spark, sf), RANGE)
    except CoverageError as error:
        return error.gaps.select("key", "gap_start", "gap_end")
    return data.users(spark, sf).limit(0).select("key", F.lit("").alias("gap_start"), F.lit("").alias("gap_end"))


@register(f"""{_GAPS}
SELECT j.key, CAST(cs AS VARCHAR) AS covered_start, CAST(ce AS VARCHAR) AS covered_end,
  count(a) = 0 AS complete, coalesce(string_agg(a || ':' || b, ',' ORDER BY a), '') AS missing
FROM j LEFT JOIN g ON g.key = j.key GROUP BY j.key, cs, ce""")
def coverage_report(spark, sf):
    requests = cov.requests_for(data.users(spark, sf), *RANGE)
    shown = F.transform(
        "missing", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))
    )
    return cov.report(requests, data.hull(spark, sf, "signup")).select(
        "key", "covered_start", "covered_end", "complete", F.array_join(shown, ",").alias("missing")
    )


@register(f"""
WITH r AS ({hull_sql('click')}), c AS ({hull_sql('signup')}),
j AS (SELECT r.key, r.start AS s, r."end" AS e, c.start AS cs, c."end" AS ce
  FROM r LEFT JOIN c ON r.key = c.key)
SELECT key, CAST(a AS VARCHAR) AS work_start, CAST(b AS VARCHAR) AS work_end FROM (
  SELECT key, s AS a, e AS b FROM j WHERE cs IS NULL
  UNION ALL SELECT key, s, cs FROM j WHERE cs IS NOT NULL AND s < cs AND e < cs
  UNION ALL SELECT key, ce, e FROM j WHERE cs IS NOT NULL AND e > ce AND s > ce
  UNION ALL SELECT key, s, cs FROM j WHERE s < cs AND e >= cs
  UNION ALL SELECT key, ce, e FROM j WHERE e > ce AND s <= ce)""")
def continuity_missing(spark, sf):
    """What to fetch so that coverage stays one interval per key."""
    work = cov.continuity_gaps(data.hull(spark, sf, "click"), data.hull(spark, sf, "signup"))
    return work.select("key", "work_start", "work_end")


def _signup_days(spark, sf):
    return data.events(spark, sf).where("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("key"),
        F.col("day").alias("start"),
        F.date_add("day", 1).alias("end"),
    )


_PARTS = f"""
WITH i AS ({hull_sql('error')} UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(ts AS DATE),
  CAST(ts AS DATE) + 1 FROM events WHERE event_type = 'signup'),
m AS (SELECT *, max("end") OVER (PARTITION BY key ORDER BY start, "end"
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER
  (PARTITION BY key ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS part FROM m),
p AS (SELECT key, part, min(start) AS start, max("end") AS "end" FROM n GROUP BY key, part)"""


@register(f"""{_PARTS} SELECT key, CAST(min(start) AS VARCHAR) AS start, CAST(max("end") AS VARCHAR) AS "end"
FROM p GROUP BY key""")
def coverage_merge_hull(spark, sf):
    return cov.merge(data.hull(spark, sf, "error"), _signup_days(spark, sf), "hull")


@register(f"""{_PARTS} SELECT key, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end"
FROM p WHERE part = 1""")
def coverage_merge_keep_left(spark, sf):
    return cov.merge(data.hull(spark, sf, "error"), _signup_days(spark, sf), "keep_left")


@register(f"""{_PARTS} SELECT key, CAST(count(*) AS INTEGER) AS parts FROM p GROUP BY key HAVING count(*) > 1""")
def coverage_merge_gapcheck(spark, sf):
    return cov.holes(data.hull(spark, sf, "error"), _signup_days(spark, sf))


@register(f"""
WITH r AS ({hull_sql('view')}), c AS ({hull_sql('click')})
SELECT r.key FROM r LEFT JOIN c ON r.key = c.key
WHERE c.key IS NULL OR r.start < c.start OR r."end" > c."end" """)
def refresh_outside(spark, sf):
    """Refresh requests that leave coverage."""
    return cov.outside(data.hull(spark, sf, "view"), data.hull(spark, sf, "click")).select("key")


# calendar and dates


@register(f"""WITH days AS ({DAYS_SQL}), c AS ({CALENDAR_SQL})
SELECT DISTINCT CAST(cal_date AS VARCHAR) AS cal_date FROM c
WHERE is_open AND cal_date >= DATE '2024-01-05' AND cal_date < DATE '2024-01-25'""")
def calendar_open_dates(spark, sf):
    return cal.open_dates(data.calendar(spark, sf), RANGE)


@register(f"""WITH days AS ({DAYS_SQL}), c AS ({CALENDAR_SQL})
SELECT exchange, CAST(cal_date AS VARCHAR) AS cal_date, is_open, CAST((SELECT max(p.cal_date) FROM c p
  WHERE p.exchange = c.exchange AND p.is_open AND p.cal_date < c.cal_date) AS VARCHAR)
  AS derived_pretrade_date FROM c""")
def calendar_pretrade(spark, sf):
    return cal.previous_open(data.calendar(spark, sf))


@register(f"""WITH days AS ({DAYS_SQL}), c AS ({CALENDAR_SQL}), jobs AS ({hull_sql('purchase')})
SELECT DISTINCT CAST(cal_date AS VARCHAR) AS cal_date FROM c WHERE is_open AND EXISTS
  (SELECT 1 FROM jobs WHERE c.cal_date >= jobs.start AND c.cal_date < jobs."end")""")
def open_dates_in_jobs(spark, sf):
    """Open dates inside any job interval, without expanding the jobs to dates."""
    return cal.open_dates_in(data.calendar(spark, sf), data.hull(spark, sf, "purchase"))


@register("""
SELECT o_orderkey, CAST(count(*) FILTER (isodow(d) < 6) AS INTEGER) AS weekdays FROM
  (SELECT o_orderkey, unnest(generate_series(CAST(o_orderdate AS DATE),
    CAST(o_orderdate AS DATE) + 9, INTERVAL 1 DAY)) AS d FROM orders) GROUP BY o_orderkey""")
def weekdays_of_range(spark, sf):
    day = F.col("o_orderdate")
    return data.orders(spark, sf).select(
        "o_orderkey", F.size(dates.weekdays(day, F.date_add(day, 10))).alias("weekdays")
    )


@register("""
SELECT o_orderkey, CAST(date_trunc('month', d) AS DATE)::VARCHAR AS month,
  CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE)::VARCHAR AS previous,
  CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE)::VARCHAR AS next,
  CAST(date_trunc('month', d) AS DATE)::VARCHAR AS first_day,
  CAST(date_trunc('month', d + 39) + INTERVAL 1 MONTH AS DATE)::VARCHAR AS end_day
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def month_expand(spark, sf):
    day = F.col("o_orderdate")
    first, end = dates.expand_to_months(day, F.date_add(day, 40))
    return data.orders(spark, sf).select(
        "o_orderkey",
        dates.month(day).alias("month"),
        dates.previous_month(day).alias("previous"),
        dates.next_month(day).alias("next"),
        first.alias("first_day"),
        end.alias("end_day"),
    )


@register("""
SELECT o_orderkey, CAST(CAST(unnest(generate_series(date_trunc('month', d), d + 59,
  INTERVAL 1 MONTH)) AS DATE) AS VARCHAR) AS month
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def month_starts(spark, sf):
    day = F.col("o_orderdate")
    return data.orders(spark, sf).select(
        "o_orderkey", F.explode(dates.month_starts(day, F.date_add(day, 60))).alias("month")
    )


@register("""
SELECT o_orderkey, strftime(d, '%Y%m%d') AS first, strftime(d + 6, '%Y%m%d') AS last,
  d || ':' || (d + 7) AS text FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def provider_ranges(spark, sf):
    """Half-open ranges as the provider's inclusive form and as text."""
    start, end = F.col("o_orderdate"), F.date_add("o_orderdate", 7)
    first, last = dates.provider_inclusive(start, end)
    return data.orders(spark, sf).select(
        "o_orderkey", first.alias("first"), last.alias("last"), dates.format_range(start, end).alias("text")
    )


@register("""
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderpriority
  WHEN '1-URGENT' THEN CAST(o_orderdate AS DATE) || ':today'
  WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y%m%d') || ':2024-01-20'
  WHEN '3-MEDIUM' THEN '2024-01-20:' || CAST(o_orderdate AS DATE)
  WHEN '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) || ':2024-01-20:x'
  ELSE CAST(o_orderdate AS DATE) || ':' || (CAST(o_orderdate AS DATE) + 3) END AS text, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CASE WHEN p IN ('1-URGENT', '5-LOW') THEN CAST(d AS VARCHAR) END AS start,
  CASE p WHEN '1-URGENT' THEN '2024-01-20' WHEN '5-LOW' THEN CAST(d + 3 AS VARCHAR) END AS "end",
  CASE p WHEN '2-HIGH' THEN 'invalid date' WHEN '3-MEDIUM' THEN 'empty or reversed'
    WHEN '4-NOT SPECIFIED' THEN 'not start:end' END AS status FROM t""")
def parse_ranges(spark, sf):
    """Range text, valid and not, rendered from order dates."""
    day = F.col("o_orderdate").cast("string")
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.concat(day, F.lit(":today")))
        .when(p == "2-HIGH", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(":2024-01-20")))
        .when(p == "3-MEDIUM", F.concat(F.lit("2024-01-20:"), day))
        .when(p == "4-NOT SPECIFIED", F.concat(day, F.lit(":2024-01-20:x")))
        .otherwise(F.concat(day, F.lit(":"), F.date_add("o_orderdate", 3).cast("string")))
    )
    rows = data.orders(spark, sf).select("o_orderkey", text.alias("text"))
    return dates.parse_ranges(rows, "text", date(2024, 1, 20)).drop("text")


@register("""
SELECT event_id, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN 'after-window'
  WHEN CAST(ts AS DATE) > DATE '2024-01-20' THEN 'before-window' ELSE 'inside-window' END AS "window"
FROM events""")
def publication_daily(spark, sf):
    return data.events(spark, sf).select(
        "event_id", dates.daily_window(F.col("day"), data.NOW).alias("window")
    )


@register("""
SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-03-01' THEN 'after-window'
  WHEN CAST(o_orderdate AS DATE) >= DATE '1998-04-01' THEN 'before-window' ELSE 'inside-window' END AS "window"
FROM orders""")
def publication_monthly(spark, sf):
    from datetime import datetime, timezone

    # still February in UTC, March on the market's clock
    now = datetime(1998, 2, 28, 20, 0, tzinfo=timezone.utc)
    return data.orders(spark, sf).select(
        "o_orderkey", dates.monthly_window(F.col("o_orderdate"), now).alias("window")
    )


# status


@register("""SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY c_mktsegment""")
def status_by_group(spark, sf):
    return status.by_group(table(spark, sf, "customer"), "c_mktsegment", "customers")


@register("""SELECT 'S' || l_suppkey AS index_code, CAST(count(DISTINCT l_partkey) AS BIGINT) AS constituents
FROM lineitem GROUP BY l_suppkey""")
def members_per_index(spark, sf):
    return status.members_per_index(data.holdings(spark, sf))
