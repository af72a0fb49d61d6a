"""Mutations, provider rows, membership, planning and ingest."""

from datetime import date

from pyspark.sql import functions as F

from covspark.functions import selectors
from covspark.functions.requests import canonical_list, request_key
from covspark.operators import calendar as cal
from covspark.operators import members, mutate, validate
from covspark.operators import coverage as cov
from covspark.operators import ordered
from covspark.operators.mutate import Mutation
from covspark.plans import batches, ingest, maintain, work
from covspark.sources import envelope
from covspark.spec import INDEX_WEIGHT, DatasetSpec, fields
from oracle_queries import data
from oracle_queries.data import CALENDAR_SQL, DAYS_SQL, EVENTS_SQL, WEIGHTS_SQL, hull_sql
from oracle_queries.registry import register, table

# mutations


def _order_changes(spark, sf):
    """Finished orders come again at double price; pending ones also under a new key."""
    rows = data.orders(spark, sf)
    again = rows.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    new = rows.where("o_orderstatus = 'P'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return again.unionByName(new)


_ORDERS = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS "
    "o_orderdate, o_orderpriority FROM orders"
)
_CHANGES = f"""SELECT * REPLACE (o_totalprice * 2 AS o_totalprice) FROM ({_ORDERS}) WHERE o_orderstatus = 'F'
  UNION ALL SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM ({_ORDERS}) WHERE o_orderstatus = 'P'"""


@register(f"""WITH inc AS ({_CHANGES})
SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM (SELECT * FROM ({_ORDERS})
  WHERE o_orderkey NOT IN (SELECT o_orderkey FROM inc) UNION ALL SELECT * FROM inc)""")
def upsert_pk(spark, sf):
    """Primary-key replacement."""
    return mutate.apply(
        data.orders(spark, sf), [Mutation.primary_keys(_order_changes(spark, sf))], data.ORDERS
    )


def _shifted(spark, sf, event_type):
    """Events of one type again, under new ids and with another value."""
    return (
        data.event_days(spark, sf)
        .where(F.col("event_type") == event_type)
        .withColumn("event_id", -F.col("event_id") - 1)
        .withColumn("value", F.col("value") + 1000)
    )


_DAYS = (
    "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day, event_id, event_type, "
    "value FROM events"
)


def _shifted_sql(event_type):
    return (
        "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day, -event_id - 1 AS event_id, "
        f"event_type, value + 1000 AS value FROM events WHERE event_type = '{event_type}'"
    )


def _outside(rows, scopes):
    return f"""SELECT * FROM {rows} x WHERE NOT EXISTS (SELECT 1 FROM {scopes} s WHERE s.key = x.user_id
  AND x.day >= s.start AND x.day < s."end")"""


@register(f"""WITH base AS ({_DAYS}), inc AS ({_shifted_sql('purchase')}), scopes AS ({hull_sql('purchase')})
SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({_outside('base', 'scopes')} UNION ALL SELECT * FROM inc)""")
def replace_ranges(spark, sf):
    """Each user's purchase range is replaced by new rows."""
    inc = _shifted(spark, sf, "purchase")
    scopes = data.hull(spark, sf, "purchase")
    return mutate.apply(
        data.event_days(spark, sf), [Mutation.ranges(inc, scopes)], data.EVENT_DAYS
    )


@register(f"""
WITH base AS ({_DAYS}), s0 AS ({hull_sql('purchase')}), i0 AS ({_shifted_sql('purchase')}),
t0 AS ({_outside('base', 's0')} UNION ALL SELECT * FROM i0),
i1 AS (SELECT user_id, day, event_id, event_type, value + 5 AS value FROM ({_DAYS}) WHERE event_type = 'view'
  UNION ALL SELECT user_id, day, -event_id - 1, event_type, value - 5 FROM ({_DAYS}) WHERE event_type = 'purchase'),
t1 AS (SELECT * FROM t0 WHERE NOT EXISTS (SELECT 1 FROM i1 WHERE i1.user_id = t0.user_id AND
  i1.day = t0.day AND i1.event_id = t0.event_id) UNION ALL SELECT * FROM i1),
s2 AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS start, CAST(ts AS DATE) + 1 AS "end"
  FROM events WHERE event_type = 'error'),
i2 AS (SELECT user_id, day, event_id, 'kept' AS event_type, value FROM ({_DAYS}) WHERE event_type = 'error'),
t2 AS ({_outside('t1', 's2')} UNION ALL SELECT * FROM i2)
SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM t2""")
def apply_sequence(spark, sf):
    """Range, primary-key and range replacement in one commit, applied in one pass."""
    base = data.event_days(spark, sf)
    first = Mutation.ranges(_shifted(spark, sf, "purchase"), data.hull(spark, sf, "purchase"))
    views = base.where("event_type = 'view'").withColumn("value", F.col("value") + 5)
    bought = (
        base.where("event_type = 'purchase'")
        .withColumn("event_id", -F.col("event_id") - 1)
        .withColumn("value", F.col("value") - 5)
    )
    errors = base.where("event_type = 'error'").withColumn("event_type", F.lit("kept"))
    scopes = ingest.market_scopes(errors, data.EVENT_DAYS)
    return mutate.apply(
        base,
        [
            first,
            Mutation.primary_keys(views.unionByName(bought)),
            Mutation.ranges(errors, scopes),
        ],
        data.EVENT_DAYS,
    )


@register("""
WITH i AS (SELECT c_nationkey, c_custkey AS pos, c_name, c_acctbal FROM customer WHERE c_nationkey % 3 <> 1
  UNION ALL SELECT n_nationkey, -1, n_name, 0.0 FROM nation WHERE n_nationkey % 5 <> 2)
SELECT c_nationkey, arg_max(c_name, pos) AS c_name, arg_max(c_acctbal, pos) AS c_acctbal FROM i
GROUP BY c_nationkey""")
def merge_last_wins(spark, sf):
    """Union by key where incoming rows, and among them later ones, win; some keys are only old or only new."""
    base = table(spark, sf, "nation").where("n_nationkey % 5 <> 2").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("n_name").alias("c_name"),
        F.lit(0.0).alias("c_acctbal"),
    )
    rows = table(spark, sf, "customer").where("c_nationkey % 3 <> 1").select("c_nationkey", "c_name", "c_acctbal", "c_custkey")
    return mutate.merge_last_wins(base, rows, ["c_nationkey"], "c_custkey")


# provider rows

RAW = DatasetSpec(
    "driver/raw_events",
    fields("event_id long!, day date!, value double, kind byte, is_open boolean!, event_type string"),
    primary_key=("event_id",),
)


def _responses(spark, sf):
    """Events rendered to provider envelopes of a thousand ids each.

    Errors lose their date, signups their value, views get a date with a time part and a
    kind too large for a byte. ``event_type`` is named twice and ``extra`` is undeclared.
    """
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    day = F.date_format("ts", "yyyyMMdd")
    item = F.array(
        F.col("event_id").cast("string"),
        F.lit("first"),
        F.when(kind == "error", F.lit(""))
        .when(kind == "view", F.concat(day, F.lit(" 00:00:00")))
        .otherwise(day),
        F.when(kind == "signup", F.lit("")).otherwise(F.col("value").cast("string")),
        F.when(kind == "view", F.lit("200")).otherwise(F.lit("7")),
        F.when(kind == "click", F.lit("1")).otherwise(F.lit("0")),
        F.lit("x"),
        kind,
    )
    names = ["event_id", "event_type", "day", "value", "kind", "is_open", "extra", "event_type"]
    return (
        e.select(F.floor(F.col("event_id") / 1000).alias("request_id"), item.alias("item"))
        .groupBy("request_id")
        .agg(F.collect_list("item").alias("items"))
        .select(
            "request_id",
            F.to_json(
                F.struct(
                    F.lit(0).alias("code"),
                    F.lit("").alias("msg"),
                    F.struct(
                        F.array(*[F.lit(n) for n in names]).alias("fields"), "items"
                    ).alias("data"),
                )
            ).alias("response"),
        )
    )


def _raw_rows(spark, sf):
    return envelope.normalize(
        envelope.explode_items(envelope.classify(_responses(spark, sf)), RAW, ["request_id"]), RAW
    )


@register("""
SELECT CAST(event_id // 1000 AS BIGINT) AS request_id, event_id, event_type,
  CASE WHEN event_type <> 'error' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day,
  CASE WHEN event_type <> 'signup' THEN value END AS value,
  CASE WHEN event_type <> 'view' THEN CAST(7 AS TINYINT) END AS kind, event_type = 'click' AS is_open,
  CASE event_type WHEN 'error' THEN 'day: required' WHEN 'view' THEN 'kind: bad value' ELSE '' END AS problems
FROM events""")
def envelope_explode(spark, sf):
    """Provider envelopes to typed rows with the violations of each row."""
    rows = _raw_rows(spark, sf)
    return rows.withColumn("problems", F.array_join("violations", ",")).drop("violations", "row_no")


@register("""
WITH c AS (SELECT *, event_id % 12 AS k, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events)
SELECT event_id, CASE WHEN k <> 1 THEN d END AS day, CASE k WHEN 2 THEN 1.0 WHEN 3 THEN NULL ELSE value END AS value,
  CAST(CASE k WHEN 4 THEN 1 WHEN 5 THEN NULL WHEN 6 THEN 5 ELSE 7 END AS TINYINT) AS kind, k IN (7, 8) AS is_open,
  CASE WHEN k <> 10 THEN event_type END AS event_type,
  CASE k WHEN 1 THEN 'day: bad value' WHEN 3 THEN 'value: bad value' WHEN 5 THEN 'kind: bad value'
    WHEN 10 THEN 'event_type: bad value' ELSE '' END AS problems FROM c""")
def envelope_json_types(spark, sf):
    """Numbers, flags, text and lists keep their JSON kinds: what may fill a field depends on them."""
    e = table(spark, sf, "events")
    k = F.col("event_id") % 12
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    day = F.date_format("ts", "yyyyMMdd")
    cells = F.concat_ws(
        ",",
        F.col("event_id").cast("string"),
        F.when(k == 1, day).otherwise(quoted(day)),
        F.when(k == 2, "true").when(k == 3, "[1.5]").otherwise(F.col("value").cast("string")),
        F.when(k == 4, "true").when(k == 5, '"5.0"').when(k == 6, "5.5").otherwise("7"),
        F.when(k == 7, "1").when(k == 8, '"1"').when(k == 9, "1.0").when(k == 11, "true").otherwise("0"),
        F.when(k == 10, "12").otherwise(quoted(F.col("event_type"))),
    )
    body = F.concat(
        F.lit('{"code":0,"data":{"fields":["event_id","day","value","kind","is_open","event_type"],"items":[['),
        F.array_join(F.collect_list(cells), "],["),
        F.lit("]]}}"),
    )
    responses = e.groupBy(F.floor(F.col("event_id") / 1000).alias("request_id")).agg(body.alias("response"))
    rows = envelope.normalize(envelope.explode_items(envelope.classify(responses), RAW), RAW)
    return rows.withColumn("problems", F.array_join("violations", ",")).drop("violations", "row_no")


@register("""
SELECT event_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
  CASE WHEN event_type <> 'signup' THEN value END AS value, CAST(7 AS TINYINT) AS kind,
  event_type = 'click' AS is_open FROM events WHERE event_type NOT IN ('error', 'view')""")
def provider_rows(spark, sf):
    """Only the rows that satisfy the contract, in the declared schema."""
    return envelope.typed_rows(_raw_rows(spark, sf), RAW)


@register("""
SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 5 WHEN 'error' THEN NULL WHEN 'purchase' THEN 0
    WHEN 'view' THEN 0 ELSE NULL END AS BIGINT) AS code,
  CASE event_type WHEN 'click' THEN 'provider error' WHEN 'error' THEN 'not json'
    WHEN 'purchase' THEN 'data missing or invalid' WHEN 'view' THEN 'fields or items missing'
    ELSE 'code missing or invalid' END AS error_kind FROM events""")
def envelope_errors(spark, sf):
    """Protocol errors, one kind of broken response per event type."""
    return envelope.classify(_broken(spark, sf)).select("event_id", "code", "error_kind")


@register("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'provider error' WHEN 'error' THEN 'not json'
    WHEN 'purchase' THEN 'data missing or invalid' WHEN 'view' THEN 'fields or items missing'
    ELSE 'code missing or invalid' END AS problem FROM events""")
def failed_responses(spark, sf):
    """Reading a table from failed responses gives them back with the reason."""
    _, _, refused = envelope.table_from_responses(_broken(spark, sf), RAW, "event_id")
    return refused.select("event_id", "problem")


def _broken(spark, sf):
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit('{"code":5,"msg":"id '), F.col("event_id").cast("string"), F.lit('"}')))
        .when(kind == "error", F.concat(F.lit("<html>"), F.col("event_id").cast("string")))
        .when(kind == "purchase", F.lit('{"code":0,"data":[]}'))
        .when(kind == "view", F.lit('{"code":0,"data":{"fields":["a"]}}'))
        .otherwise(F.lit('{"code":"0","data":{}}'))
    )
    return data.events(spark, sf).select("event_id", text.alias("response"))


# membership


@register(f"""WITH w AS ({WEIGHTS_SQL})
SELECT index_code, CAST(date_trunc('month', trade_date) AS DATE)::VARCHAR AS effective_month, con_code,
  CAST(trade_date AS VARCHAR) AS trade_date, weight FROM w
QUALIFY trade_date = max(trade_date) OVER (PARTITION BY index_code, date_trunc('month', trade_date))""")
def snapshot_latest_in_month(spark, sf):
    return members.latest_in_month(data.weights(spark, sf))


def _requests(spark, sf, selection):
    """One request per supplier, with a range that depends on its nation."""
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("index_code"),
        F.date_add(F.lit(date(1994, 12, 25)), F.col("s_nationkey") * 90).alias("start"),
        F.date_add(F.lit(date(1995, 1, 6)), F.col("s_nationkey") * 95).alias("end"),
        F.lit(selection).alias("selection"),
    )


_REQ = """r AS (SELECT 'S' || s_suppkey AS index_code, DATE '1994-12-25' + s_nationkey * 90 AS s,
  DATE '1995-01-06' + s_nationkey * 95 AS e FROM supplier)"""


@register(f"""WITH w AS ({WEIGHTS_SQL}), {_REQ},
d AS (SELECT DISTINCT 'S' || l_suppkey AS index_code, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem),
p AS (SELECT r.index_code, r.e, max(d.trade_date) FILTER (d.trade_date < r.e) AS d FROM r JOIN d ON d.index_code = r.index_code
  GROUP BY r.index_code, r.e)
SELECT p.index_code, CAST(p.e AS VARCHAR) AS "end", w.con_code AS symbol FROM p JOIN w
  ON w.index_code = p.index_code AND w.trade_date = p.d""")
def members_latest(spark, sf):
    """The greatest snapshot strictly before the end."""
    found = members.resolve(_requests(spark, sf, "latest"), data.holdings(spark, sf))
    return found.select("index_code", "end", "symbol")


_UNION = f"""WITH w AS ({WEIGHTS_SQL}), {_REQ},
p AS (SELECT r.index_code, r.s, r.e, max(w.trade_date) FILTER (w.trade_date <= r.s) AS f,
  count(w.trade_date) AS n FROM r LEFT JOIN w ON w.index_code = r.index_code AND w.trade_date < r.e
  GROUP BY r.index_code, r.s, r.e)"""


@register(f"""{_UNION}
SELECT DISTINCT p.index_code, CAST(p.s AS VARCHAR) AS start, w.con_code AS symbol FROM p JOIN w
  ON w.index_code = p.index_code AND w.trade_date >= p.f AND w.trade_date < p.e""")
def members_range_union(spark, sf):
    """The snapshot in force at the start and every later one before the end."""
    found = members.resolve(_requests(spark, sf, "range_union"), data.holdings(spark, sf))
    return found.select("index_code", "start", "symbol")


@register(f"""{_UNION}
SELECT index_code, CAST(s AS VARCHAR) AS start, CASE WHEN n = 0 THEN 'no snapshot before end'
  ELSE 'no snapshot on or before start' END AS status FROM p WHERE n = 0 OR f IS NULL""")
def members_problems(spark, sf):
    """Requests no snapshot can answer."""
    found = members.problems(_requests(spark, sf, "range_union"), data.holdings(spark, sf))
    return found.select("index_code", "start", "status")


@register(f"""WITH w AS ({WEIGHTS_SQL}), {_REQ}
SELECT DISTINCT r.index_code, w.con_code AS symbol FROM r JOIN w ON w.index_code = r.index_code
  AND w.trade_date >= r.s AND w.trade_date < r.e""")
def members_in_range(spark, sf):
    return members.in_range(data.holdings(spark, sf), _requests(spark, sf, "range"))


@register("""
WITH w AS (SELECT DISTINCT s_nationkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey),
o AS (SELECT o_orderkey, c_nationkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders
  JOIN customer ON o_custkey = c_custkey)
SELECT o.o_orderkey, CAST(w.d AS VARCHAR) AS snapshot FROM o ASOF LEFT JOIN w ON o.k = w.k AND o.d >= w.d""")
def members_asof(spark, sf):
    """As-of join: for each order the latest ship date of its customer's nation."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    w = (
        table(spark, sf, "lineitem")
        .select("l_suppkey", F.to_date("l_shipdate").alias("trade_date"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("s_nationkey").alias("index_code"), "trade_date")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = data.orders(spark, sf).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return members.as_of(o, w, "c_nationkey", "o_orderdate").select("o_orderkey", "snapshot")


def _selectors(spark, sf):
    """Selector texts of every grammar form, built from customers."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    code = F.concat(F.lit("S"), F.col("c_nationkey").cast("string"), F.lit(".XX"))
    text = (
        F.when(name == "BUILDING", F.concat(F.lpad(key, 6, "0"), F.lit(".SZ")))
        .when(name == "AUTOMOBILE", F.concat(F.lit("tushare:"), code))
        .when(name == "MACHINERY", F.concat(F.lit("tushare:"), code, F.lit("@latest")))
        .when(name == "HOUSEHOLD", F.concat(F.lit("tushare:"), code, F.lit("@199702")))
        .otherwise(F.concat(F.lit("tushare:"), code, F.lit("@199713")))
    )
    return table(spark, sf, "customer").select("c_custkey", text.alias("selector"))


_SEL = """CASE c_mktsegment WHEN 'BUILDING' THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.SZ'
  WHEN 'AUTOMOBILE' THEN 'tushare:S' || c_nationkey || '.XX' WHEN 'MACHINERY'
  THEN 'tushare:S' || c_nationkey || '.XX@latest' WHEN 'HOUSEHOLD' THEN 'tushare:S' || c_nationkey || '.XX@199702'
  ELSE 'tushare:S' || c_nationkey || '.XX@199713' END"""


@register(f"""SELECT c_custkey, {_SEL} AS selector,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'security' WHEN 'AUTOMOBILE' THEN 'index' WHEN 'MACHINERY' THEN 'index'
    WHEN 'HOUSEHOLD' THEN 'index' ELSE 'invalid' END AS kind,
  CASE c_mktsegment WHEN 'BUILDING' THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.SZ' WHEN 'AUTOMOBILE'
    THEN 'S' || c_nationkey || '.XX' WHEN 'MACHINERY' THEN 'S' || c_nationkey || '.XX'
    WHEN 'HOUSEHOLD' THEN 'S' || c_nationkey || '.XX' END AS code,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'range' WHEN 'MACHINERY' THEN 'latest' WHEN 'HOUSEHOLD' THEN '199702' END
    AS selection FROM customer""")
def selector_parse(spark, sf):
    return _selectors(spark, sf).select(
        "c_custkey", "selector", selectors.parse_selector(F.col("selector")).alias("s")
    ).select("c_custkey", "selector", "s.*")


@register("""
WITH w AS (SELECT DISTINCT 'S' || s_nationkey || '.XX' AS i, 'P' || l_partkey AS c, CAST(l_shipdate AS DATE) AS d
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
q AS (SELECT 'S' || c_nationkey || '.XX' AS i, c_mktsegment AS m,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN DATE '1998-01-01' WHEN 'MACHINERY' THEN DATE '1998-01-20'
    ELSE DATE '1997-02-01' END AS s,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN DATE '1997-03-01' ELSE DATE '1998-01-21' END AS e
  FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')),
r AS (SELECT i, min(s) AS s, max(e) AS e, bool_or(m = 'AUTOMOBILE') AS u FROM q GROUP BY i),
p AS (SELECT r.i, r.e, r.u, max(w.d) FILTER (w.d <= r.s) AS f, max(w.d) AS l FROM r JOIN w
  ON w.i = r.i AND w.d < r.e GROUP BY r.i, r.e, r.u)
SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.SZ' AS symbol FROM customer WHERE c_mktsegment = 'BUILDING'
UNION SELECT w.c FROM p JOIN w ON w.i = p.i AND w.d < p.e AND w.d >= CASE WHEN p.u THEN p.f ELSE p.l END""")
def selector_expand(spark, sf):
    """Direct securities plus the members every index selector stands for."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    w = (
        table(spark, sf, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_nationkey").cast("string"), F.lit(".XX")).alias("index_code"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("con_code"),
            F.to_date("l_shipdate").alias("trade_date"),
        )
    )
    return members.expand_selectors(_selectors(spark, sf), w, (date(1998, 1, 1), date(1998, 1, 21)))


@register("""SELECT l_partkey, CAST(min(l_orderkey) AS BIGINT) AS first_position FROM lineitem GROUP BY l_partkey""")
def first_seen(spark, sf):
    """Distinct values with the place they first appeared."""
    return members.first_seen(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


# planning and ingest


@register("""
SELECT o_orderkey, CAST(d AS VARCHAR) AS start, CASE WHEN d < b THEN CAST(least(d + 60, b) AS VARCHAR) END AS due_end,
  CASE WHEN d >= b THEN 'not due' WHEN d + 60 > b THEN 'clamped' ELSE 'due' END AS status
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1998-06-10' AS b FROM orders)""")
def due_clamp(spark, sf):
    """Ends cut at the due boundary; at 10:00 the day itself is not due."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    now = datetime(1998, 6, 10, 10, 0, tzinfo=ZoneInfo("Asia/Shanghai"))
    requests = data.orders(spark, sf).select(
        "o_orderkey", F.col("o_orderdate").alias("start"), F.date_add("o_orderdate", 60).alias("end")
    )
    return work.clamp_due(requests, now).select("o_orderkey", "start", "due_end", "status")


_JOBS = f"""r AS ({hull_sql('click')}), k AS ({hull_sql('signup')}),
jobs AS (SELECT r.key, CASE WHEN k.key IS NULL THEN r.start ELSE r.start END AS start,
  CASE WHEN k.key IS NULL THEN r."end" ELSE k.start END AS "end" FROM r LEFT JOIN k ON r.key = k.key
  WHERE k.key IS NULL OR r.start < k.start
  UNION ALL SELECT r.key, k."end", r."end" FROM r JOIN k ON r.key = k.key WHERE r."end" > k."end")"""


def _jobs(spark, sf):
    found = cov.continuity_gaps(data.hull(spark, sf, "click"), data.hull(spark, sf, "signup"))
    return found.select("key", F.col("work_start").alias("start"), F.col("work_end").alias("end"))


@register(f"""WITH days AS ({DAYS_SQL}), c AS ({CALENDAR_SQL}), {_JOBS},
o AS (SELECT DISTINCT cal_date FROM c WHERE is_open AND EXISTS (SELECT 1 FROM jobs
  WHERE c.cal_date >= jobs.start AND c.cal_date < jobs."end")),
n AS (SELECT (SELECT count(*) FROM jobs) AS key_requests, (SELECT count(*) FROM o) AS market_requests)
SELECT CAST(key_requests AS BIGINT) AS key_requests, CAST(market_requests AS BIGINT) AS market_requests,
  CASE WHEN market_requests > 0 AND market_requests < key_requests THEN 'market' ELSE 'per-key' END AS shape FROM n""")
def work_shape(spark, sf):
    """Requests per key against market-wide requests per open date."""
    jobs = _jobs(spark, sf)
    return work.shape_counts(jobs, cal.open_dates_in(data.calendar(spark, sf), jobs))


@register(f"""WITH {_JOBS}
SELECT event_id FROM ({EVENTS_SQL}) e WHERE EXISTS (SELECT 1 FROM jobs WHERE jobs.key = CAST(e.user_id AS VARCHAR)
  AND e.day >= jobs.start AND e.day < jobs."end")""")
def by_date_filter(spark, sf):
    """Market-wide rows kept only where a job asked for them."""
    rows = data.event_days(spark, sf)
    return ingest.demanded_rows(rows, _jobs(spark, sf), data.EVENT_DAYS).select("event_id")


@register(f"""WITH days AS ({DAYS_SQL}), c AS ({CALENDAR_SQL}), {_JOBS}
SELECT DISTINCT jobs.key, CAST(c.cal_date AS VARCHAR) AS cal_date FROM jobs JOIN c ON c.is_open
  AND c.cal_date >= jobs.start AND c.cal_date < jobs."end"
WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'view' AND CAST(user_id AS VARCHAR) = jobs.key
  AND CAST(ts AS DATE) = c.cal_date)""")
def absent_cells(spark, sf):
    """Demanded (key, date) cells the answers did not contain."""
    from covspark.operators import calendar as cal

    rows = data.event_days(spark, sf).where("event_type = 'view'")
    return ingest.absent_cells(
        rows, _jobs(spark, sf), cal.open_dates(data.calendar(spark, sf)), data.EVENT_DAYS
    )


@register(f"""SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CAST(day AS VARCHAR) AS start,
  CAST(day + 1 AS VARCHAR) AS "end" FROM ({EVENTS_SQL})""")
def market_scopes(spark, sf):
    return ingest.market_scopes(data.event_days(spark, sf), data.EVENT_DAYS)


@register(f"""WITH base AS (SELECT CAST(day AS DATE) AS day, key, mid FROM (
  SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS key, event_id AS mid FROM events WHERE event_type = 'view')),
rows AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS key, -event_id - 1 AS mid FROM events
  WHERE event_type = 'click'),
t AS (SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM rows WHERE rows.key = base.key AND rows.day = base.day)
  UNION ALL SELECT * FROM rows)
SELECT key AS user_id, CAST(day AS VARCHAR) AS day, mid AS event_id FROM t""")
def market_ingest(spark, sf):
    """Every key in a day's answer has that day replaced."""
    rows = _shifted(spark, sf, "click")
    base = data.event_days(spark, sf).where("event_type = 'view'")
    plan = ingest.market(rows, data.EVENT_DAYS, data.hull(spark, sf, "view"), "hull")
    return mutate.apply(base, [plan.mutation], data.EVENT_DAYS).select("user_id", "day", "event_id")


@register("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS rows,
  count(*) >= (SELECT quantile_disc(n, 0.5) FROM (SELECT count(*) AS n FROM events GROUP BY CAST(ts AS DATE))) AS saturated
FROM events GROUP BY CAST(ts AS DATE)""")
def saturated_requests(spark, sf):
    """Answers that reached the row limit and may be cut off."""
    return validate.saturated(data.events(spark, sf), ["day"], _median_day(spark, sf))


@register(f"""
WITH j AS ({hull_sql('click')}),
h AS (SELECT j.key, j."end", count(e.event_id) AS n FROM j LEFT JOIN events e ON CAST(e.user_id AS VARCHAR) = j.key
  AND e.event_type = 'signup' AND CAST(e.ts AS DATE) >= j.start AND CAST(e.ts AS DATE) < j."end" GROUP BY j.key, j."end"),
p AS (SELECT unnest(['strict', 'accept-empty', 'best-effort']) AS policy)
SELECT h.key, p.policy, CASE WHEN n = 0 THEN CASE p.policy WHEN 'strict' THEN 'failure'
  WHEN 'best-effort' THEN 'no promise' ELSE CASE WHEN "end" - 1 < DATE '2024-01-20' THEN 'resolved' ELSE 'unresolved' END
  END END AS status FROM h, p""")
def empty_rule(spark, sf):
    """What an answer without rows means under each missing-data policy."""
    from covspark.functions import dates

    jobs = data.hull(spark, sf, "click")
    rows = data.events(spark, sf).where("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("key"), "day"
    )
    hits = jobs.join(rows.distinct(), "key", "left").groupBy("key", "start", "end").agg(
        F.count_if((F.col("day") >= F.col("start")) & (F.col("day") < F.col("end"))).alias("n")
    )
    policies = F.array(F.lit("strict"), F.lit("accept-empty"), F.lit("best-effort"))
    return hits.withColumn("policy", F.explode(policies)).select(
        "key",
        "policy",
        work.classify_empty(
            F.col("policy"), dates.daily_window(F.date_sub("end", 1), data.NOW), F.col("n")
        ).alias("status"),
    )


_MONTHS = """
req AS (SELECT 'S' || s_suppkey AS key, DATE '1996-01-15' + s_nationkey * 30 AS s,
  DATE '1996-05-20' + s_nationkey * 40 AS e FROM supplier),
q AS (SELECT key, CAST(date_trunc('month', s) AS DATE) AS s,
  CAST(date_trunc('month', e - 1) + INTERVAL 1 MONTH AS DATE) AS e FROM req),
k AS (SELECT 'S' || l_suppkey AS key, CAST(date_trunc('month', min(l_shipdate)) AS DATE) AS cs,
  CAST(date_trunc('month', max(l_shipdate)) + INTERVAL 1 MONTH AS DATE) AS ce FROM lineitem
  WHERE l_linenumber = 6 AND l_discount > 0.08 GROUP BY l_suppkey),
g AS (SELECT q.key, q.s AS a, coalesce(k.cs, q.e) AS b FROM q LEFT JOIN k ON q.key = k.key WHERE k.cs IS NULL OR q.s < k.cs
  UNION ALL SELECT q.key, k.ce, q.e FROM q JOIN k ON q.key = k.key WHERE q.e > k.ce)"""


@register(f"""WITH {_MONTHS},
m AS (SELECT key, CAST(unnest(generate_series(a, b - 1, INTERVAL 1 MONTH)) AS DATE) AS month FROM g
  UNION SELECT key, DATE '1998-01-01' FROM q WHERE s <= DATE '1998-01-01' AND e > DATE '1998-01-01')
SELECT key, CAST(month AS VARCHAR) AS month, CASE WHEN month < DATE '1998-01-01' THEN 'after-window'
  WHEN month = DATE '1998-01-01' THEN 'inside-window' ELSE 'before-window' END AS "window" FROM m""")
def index_months(spark, sf):
    """Missing index-months and the mutable current month, with their publication window."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    now = datetime(1998, 1, 20, 9, 0, tzinfo=ZoneInfo("Asia/Shanghai"))
    requests = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("key"),
        F.date_add(F.lit(date(1996, 1, 15)), F.col("s_nationkey") * 30).alias("start"),
        F.date_add(F.lit(date(1996, 5, 20)), F.col("s_nationkey") * 40).alias("end"),
    )
    ship = F.to_date("l_shipdate")
    held = (
        table(spark, sf, "lineitem")
        .where("l_linenumber = 6 AND l_discount > 0.08")
        .groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("key"))
        .agg(
            F.trunc(F.min(ship), "MM").alias("start"),
            F.add_months(F.trunc(F.max(ship), "MM"), 1).alias("end"),
        )
    )
    return work.index_months(requests, held, now)


@register("""SELECT DISTINCT l_suppkey AS code FROM lineitem WHERE l_suppkey NOT IN
  (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000.0)""")
def missing_references(spark, sf):
    """Referenced codes without a metadata row."""
    refs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"))
    known = table(spark, sf, "supplier").where("s_acctbal > 1000.0").select(
        F.col("s_suppkey").alias("code")
    )
    return work.missing_references(refs, known, "code")


@register("""
WITH a AS (SELECT CASE WHEN s_suppkey % 13 = 4 THEN -s_suppkey ELSE s_suppkey END AS k,
    CASE WHEN s_suppkey % 11 = 3 THEN 'other' ELSE s_name END AS name, unnest(CASE WHEN s_suppkey % 7 = 2 THEN [1, 2] ELSE [1] END) AS i
  FROM supplier WHERE s_suppkey % 5 <> 1),
n AS (SELECT k, count(*) AS n, count(*) FILTER (name = s_name) AS hits FROM a LEFT JOIN supplier ON s_suppkey = k GROUP BY 1)
SELECT CAST(coalesce(s_suppkey, k) AS BIGINT) AS request_id, s_name AS wanted, CAST(coalesce(n, 0) AS BIGINT) AS rows,
  CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM supplier FULL JOIN n ON k = s_suppkey
WHERE NOT coalesce(n = 1 AND hits = 1 AND s_suppkey IS NOT NULL, FALSE)""")
def exact_match(spark, sf):
    """Requests not answered by exactly the one wanted id, and answers nobody asked for: most suppliers
    match, some are missing, doubled, named otherwise or come under another request."""
    supplier = table(spark, sf, "supplier").withColumn("id", F.col("s_suppkey").cast("bigint"))
    requests = supplier.select(F.col("id").alias("request_id"), F.col("s_name").alias("wanted"))
    key = F.col("id")
    rows = supplier.where(key % 5 != 1).select(
        F.when(key % 13 == 4, -key).otherwise(key).alias("request_id"),
        F.when(key % 11 == 3, "other").otherwise(F.col("s_name")).alias("name"),
        F.explode(F.when(key % 7 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return validate.exact_match(requests, rows, "name")


@register("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
  WHERE o_orderpriority = '1-URGENT')""")
def unanswered_requests(spark, sf):
    requests = table(spark, sf, "customer").select("c_custkey")
    rows = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey")
    )
    return validate.unanswered(requests, rows, ["c_custkey"])


@register(f"""WITH q AS ({hull_sql('click')}), d AS (SELECT key, start, least("end", DATE '2024-01-21') AS "end" FROM q
  WHERE start < DATE '2024-01-21'), k AS ({hull_sql('signup')}),
j AS (SELECT d.key FROM d LEFT JOIN k ON d.key = k.key WHERE k.key IS NULL OR d.start < k.start
  UNION ALL SELECT d.key FROM d JOIN k ON d.key = k.key WHERE d."end" > k."end"),
n AS (SELECT (SELECT count(*) FROM q) AS requests, (SELECT count(*) FROM d) AS due, (SELECT count(*) FROM j) AS jobs,
  (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events WHERE isodow(ts) < 6) AS dates)
SELECT CAST(requests AS BIGINT) AS requests, CAST(due AS BIGINT) AS due, CAST(jobs AS BIGINT) AS jobs,
  CAST(dates AS BIGINT) AS dates, CAST(CASE WHEN dates > 0 AND dates < jobs THEN dates ELSE jobs END AS BIGINT)
  AS estimated_requests FROM n""")
def dry_run(spark, sf):
    """Counts a dry run shows; nothing is fetched or written."""
    days = data.events(spark, sf).where(F.weekday("day") < 5).select("day").distinct()
    return work.preview(data.hull(spark, sf, "click"), data.hull(spark, sf, "signup"), data.NOW, days)


def _order_bucket():
    """Non-decreasing along (date, key); the few priorities are large at any scale, so each
    is cut per day and again per hundred million keys."""
    ids = F.floor(F.col("o_orderkey") / 100_000_000)
    return F.struct(F.col("o_orderdate").alias("day"), ids.alias("ids"))


@register("""
SELECT o_orderpriority, o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY o_orderdate, o_orderkey) - 1) // 64 AS BIGINT) AS batch FROM orders""")
def checkpoint_batches(spark, sf):
    """Batches of 64 items in order, without putting a whole group on one task."""
    items = data.orders(spark, sf).select("o_orderpriority", "o_orderkey", "o_orderdate")
    return batches.by_count(
        items, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], _order_bucket()
    ).select("o_orderpriority", "o_orderkey", "batch")


@register("""
WITH RECURSIVE i AS (SELECT o_orderpriority AS p, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS z,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT p, k, n, 0::BIGINT AS batch, 1 AS c, z AS b FROM i WHERE n = 1
  UNION ALL SELECT i.p, i.k, i.n, CASE WHEN c >= 64 OR b >= 6000000 THEN batch + 1 ELSE batch END,
    CASE WHEN c >= 64 OR b >= 6000000 THEN 1 ELSE c + 1 END,
    CASE WHEN c >= 64 OR b >= 6000000 THEN i.z ELSE b + i.z END FROM f JOIN i ON i.p = f.p AND i.n = f.n + 1)
SELECT p AS o_orderpriority, k AS o_orderkey, batch FROM f""")
def checkpoint_batches_by_size(spark, sf):
    """A batch closes at 64 items or once its sizes reach the limit."""
    items = table(spark, sf, "orders").select(
        "o_orderpriority",
        "o_orderkey",
        F.to_date("o_orderdate").alias("o_orderdate"),
        F.floor("o_totalprice").cast("bigint").alias("bytes"),
    )
    return batches.by_size(
        items,
        ["o_orderpriority"],
        ["o_orderdate", "o_orderkey"],
        _order_bucket(),
        "bytes",
        limit=6_000_000,
    ).select("o_orderpriority", "o_orderkey", "batch")


@register("""SELECT CASE WHEN o_orderpriority < '5' THEN o_orderpriority END AS o_orderpriority, o_orderkey, CAST((row_number() OVER
  (PARTITION BY CASE WHEN o_orderpriority < '5' THEN o_orderpriority END ORDER BY o_orderdate, o_orderkey) - 1) // 64 AS BIGINT) AS batch
FROM orders""")
def batches_null_group(spark, sf):
    """Items without a group key are a group of their own; small sizes leave only the item limit."""
    items = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") < "5", F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_orderkey",
        F.to_date("o_orderdate").alias("o_orderdate"),
        F.lit(1).cast("bigint").alias("bytes"),
    )
    placed = batches.by_size(items, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], _order_bucket(), "bytes")
    return placed.select("o_orderpriority", "o_orderkey", "batch")


@register("""
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN '{"dataset":"d/' || lower(o_orderstatus) ||
  '","operands":{"symbols":["' || array_to_string(list_sort(list_distinct(string_split(s, ','))), '","') ||
  '"]},"operation":"' || CASE WHEN o_orderpriority < '3' THEN 'complete' ELSE 'refresh' END || '"}' END AS request,
  CAST(count(*) AS BIGINT) AS requests, CAST(min(o_orderkey) AS BIGINT) AS first FROM
(SELECT *, o_orderstatus || ',' || (o_custkey // 100) || ',' || o_orderstatus || ',A' AS s FROM orders) GROUP BY 1""")
def coalesce_requests(spark, sf):
    """Equal requests share a canonical key whatever the order and repeats of operands."""
    o = table(spark, sf, "orders")
    operation = (
        F.when(F.col("o_orderpriority") == "5-LOW", "update")
        .when(F.col("o_orderpriority") < "3", "complete")
        .otherwise("refresh")
    )
    symbols = F.array(
        F.col("o_orderstatus"),
        F.floor(F.col("o_custkey") / 100).cast("string"),
        F.col("o_orderstatus"),
        F.lit("A"),
    )
    key = request_key(
        F.concat(F.lit("d/"), F.lower("o_orderstatus")), operation, {"symbols": canonical_list(symbols)}
    )
    return o.groupBy(key.alias("request")).agg(
        F.count("*").alias("requests"), F.min("o_orderkey").alias("first")
    )


@register("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS position FROM orders""")
def positions(spark, sf):
    """Position in a group by way of month buckets."""
    rows = data.orders(spark, sf).select("o_custkey", "o_orderkey", "o_orderdate")
    return ordered.position(
        rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.trunc("o_orderdate", "MONTH")
    ).select("o_custkey", "o_orderkey", "position")


@register("""SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_mktsegment = 'BUILDING'
UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def stored_selectors(spark, sf):
    """The selector ``stored`` stands for every covered key."""
    named = table(spark, sf, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(
        F.when(F.col("c_mktsegment") == "MACHINERY", "stored")
        .otherwise(F.col("c_custkey").cast("string"))
        .alias("key")
    )
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    held = cov.derive(urgent, "o_custkey", "o_orderdate")
    return work.stored_or_explicit(named, held)


@register("""
SELECT o_orderkey, CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE)::VARCHAR AS start,
  CAST(date_trunc('month', d + 44) + INTERVAL 1 MONTH AS DATE)::VARCHAR AS "end"
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def membership_window(spark, sf):
    """Membership dates needed for a range."""
    start, end = members.fetch_window(F.col("o_orderdate"), F.date_add("o_orderdate", 45))
    return data.orders(spark, sf).select("o_orderkey", start.alias("start"), end.alias("end"))


@register(f"""WITH {_JOBS}, k2 AS (SELECT key, start, "end" FROM k UNION ALL SELECT * FROM jobs)
SELECT key, CAST(min(start) AS VARCHAR) AS start, CAST(max("end") AS VARCHAR) AS "end" FROM k2 GROUP BY key""")
def ingest_coverage(spark, sf):
    """Coverage after per-key answers to the continuity work: never a hole."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    now = datetime(2024, 3, 1, 12, 0, tzinfo=ZoneInfo("Asia/Shanghai"))
    jobs = _jobs(spark, sf)
    rows = ingest.demanded_rows(data.event_days(spark, sf), jobs, data.EVENT_DAYS)
    return ingest.by_key(rows, jobs, data.EVENT_DAYS, data.hull(spark, sf, "signup"), now).coverage


@register(f"""WITH {_JOBS},
h AS (SELECT jobs.key, jobs.start, jobs."end", count(e.event_id) AS n FROM jobs LEFT JOIN events e
  ON CAST(e.user_id AS VARCHAR) = jobs.key AND e.event_type = 'error' AND CAST(e.ts AS DATE) >= jobs.start
  AND CAST(e.ts AS DATE) < jobs."end" GROUP BY 1, 2, 3)
SELECT key, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", 'unresolved' AS status FROM h
WHERE n = 0 AND "end" - 1 >= DATE '2024-01-20'""")
def ingest_unresolved(spark, sf):
    """Jobs without rows whose publication window has not passed."""
    jobs = _jobs(spark, sf)
    errors = data.event_days(spark, sf).where("event_type = 'error'")
    plan = ingest.by_key(errors, jobs, data.EVENT_DAYS, data.hull(spark, sf, "signup"), data.NOW)
    return plan.problems.select("key", "start", "end", "status")


# a limit that cuts some days off at every scale: the rows of the middle day
_PER_DAY = "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1"
_CUT = f"""cut AS (SELECT d FROM ({_PER_DAY}) WHERE n >= (SELECT quantile_disc(n, 0.5) FROM ({_PER_DAY})))"""


def _median_day(spark, sf) -> int:
    per_day = data.events(spark, sf).groupBy("day").agg(F.count("*").alias("n"))
    return per_day.agg(F.expr("percentile_disc(0.5) within group (order by n)")).first()[0]


@register(f"""WITH days AS ({DAYS_SQL}), c AS ({CALENDAR_SQL}), {_JOBS},
{_CUT},
x AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS d, event_id FROM events)
SELECT event_id FROM x WHERE d NOT IN (SELECT d FROM cut) AND EXISTS (SELECT 1 FROM jobs
  WHERE jobs.key = x.key AND x.d >= jobs.start AND x.d < jobs."end")""")
def ingest_by_date(spark, sf):
    """Market-wide answers: saturated dates are set aside, the rest cut down to the demand."""
    from dataclasses import replace

    from covspark.operators import calendar as cal

    spec = replace(data.EVENT_DAYS, capabilities={"row_limit": _median_day(spark, sf)})
    plan = ingest.by_date(
        data.event_days(spark, sf),
        _jobs(spark, sf),
        cal.open_dates(data.calendar(spark, sf)),
        spec,
        data.hull(spark, sf, "signup"),
        data.NOW,
    )
    return plan.mutation.rows.select("event_id")


@register(f"""WITH {_JOBS}, {_CUT}
SELECT DISTINCT jobs.key, CAST(cut.d AS VARCHAR) AS start, CAST(cut.d + 1 AS VARCHAR) AS "end" FROM jobs
JOIN cut ON cut.d >= jobs.start AND cut.d < jobs."end" """)
def ingest_refetch(spark, sf):
    """Per-key requests for the dates whose market-wide answer was cut off."""
    from dataclasses import replace

    from covspark.operators import calendar as cal

    spec = replace(data.EVENT_DAYS, capabilities={"row_limit": _median_day(spark, sf)})
    plan = ingest.by_date(
        data.event_days(spark, sf),
        _jobs(spark, sf),
        cal.open_dates(data.calendar(spark, sf)),
        spec,
        data.hull(spark, sf, "signup"),
        data.NOW,
    )
    return plan.refetch


@register("""
SELECT c_name, arg_max(c_nationkey, c_custkey) AS c_nationkey, arg_max(c_acctbal, c_custkey) AS c_acctbal FROM (
  SELECT c_mktsegment AS c_name, c_nationkey, c_acctbal, c_custkey FROM customer) GROUP BY c_name""")
def master_snapshot(spark, sf):
    """Complete replacement: the union of all answers, a later row winning its key."""
    spec = DatasetSpec(
        "driver/master",
        fields("c_name string!, c_nationkey int, c_acctbal double"),
        primary_key=("c_name",),
    )
    rows = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("c_name"), "c_nationkey", "c_acctbal", "c_custkey"
    )
    plan = ingest.snapshot(rows, spec, ["c_nationkey"], ["c_custkey"], row_limit=10**9)
    return mutate.apply(None, [plan.mutation], spec)


# maintenance operations from selectors to requests

_LIMIT = """t AS (SELECT key, start, "end", d, (row_number() OVER (PARTITION BY key, start, "end" ORDER BY d) - 1) // {limit} AS p
  FROM jobs LEFT JOIN o ON d >= start AND d < "end"),
u AS (SELECT key, start, "end", coalesce(p, 0) AS p, min(d) AS f, count(d) AS n FROM t GROUP BY 1, 2, 3, 4),
pieces AS (SELECT key, CASE WHEN p = 0 THEN start ELSE f END AS start,
  coalesce(lead(f) OVER (PARTITION BY key, start, "end" ORDER BY p), "end") AS "end", n FROM u)"""


@register(f"""WITH days AS ({DAYS_SQL}), c AS ({CALENDAR_SQL}), {_JOBS}, o AS (SELECT DISTINCT cal_date AS d FROM c WHERE is_open),
{_LIMIT.format(limit=4)}
SELECT key, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", CAST(n AS BIGINT) AS dates FROM pieces""")
def sliced_requests(spark, sf):
    """Continuity work cut into requests of at most four open dates."""
    return work.sliced(_jobs(spark, sf), 4, cal.open_dates(data.calendar(spark, sf)))


def _ship_calendar(spark, sf):
    """Both exchanges over all civil days of shipping, open on weekdays."""
    ship = F.to_date("l_shipdate")
    span = table(spark, sf, "lineitem").agg(F.min(ship).alias("a"), F.max(ship).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("cal_date"))
    exchanges = F.explode(F.array(F.lit("SSE"), F.lit("SZSE"))).alias("exchange")
    return days.select(exchanges, "cal_date").withColumn("is_open", F.weekday("cal_date") < 5)


def _part_coverage(spark, sf):
    first = table(spark, sf, "lineitem").where("l_linenumber = 1").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part"), F.to_date("l_shipdate").alias("day")
    )
    return cov.derive(first, "part", "day")


def _nation_weights(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (
        table(spark, sf, "lineitem")
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("S"), F.col("s_nationkey").cast("string"), F.lit(".XX")).alias("index_code"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("con_code"),
            F.to_date("l_shipdate").alias("trade_date"),
        )
    )


_PARTS = """k AS (SELECT 'P' || l_partkey AS key, min(CAST(l_shipdate AS DATE)) AS cs, max(CAST(l_shipdate AS DATE)) + 1 AS ce
  FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"""
_OPEN = """o AS (SELECT d FROM (SELECT CAST(unnest(generate_series((SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem),
  (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6)"""


def _symbols_sql(start: str, end: str) -> str:
    """Keys that the selectors of all customers stand for over a range."""
    return f"""w AS (SELECT DISTINCT 'S' || s_nationkey || '.XX' AS i, 'P' || l_partkey AS c, CAST(l_shipdate AS DATE) AS d
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
sel AS (SELECT 'S' || c_nationkey || '.XX' AS i, c_mktsegment AS m,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN DATE '{start}' WHEN 'MACHINERY' THEN DATE '{end}' - 1 ELSE DATE '1997-02-01' END AS s,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN DATE '1997-03-01' ELSE DATE '{end}' END AS e
  FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')),
r AS (SELECT i, min(s) AS s, max(e) AS e, bool_or(m = 'AUTOMOBILE') AS u FROM sel GROUP BY i),
pt AS (SELECT r.i, r.e, r.u, max(w.d) FILTER (w.d <= r.s) AS f, max(w.d) AS l FROM r JOIN w
  ON w.i = r.i AND w.d < r.e GROUP BY r.i, r.e, r.u),
sym AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '.SZ' AS key FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION SELECT w.c FROM pt JOIN w ON w.i = pt.i AND w.d < pt.e AND w.d >= CASE WHEN pt.u THEN pt.f ELSE pt.l END),
q AS (SELECT key, DATE '{start}' AS s, DATE '{end}' AS e FROM sym)"""


_CONTINUITY = """jobs AS (SELECT q.key, s AS start, coalesce(cs, e) AS "end" FROM q LEFT JOIN k ON k.key = q.key WHERE cs IS NULL OR s < cs
  UNION ALL SELECT q.key, ce, e FROM q JOIN k ON k.key = q.key WHERE e > ce)"""
_SHAPED = """od AS (SELECT d FROM o WHERE EXISTS (SELECT 1 FROM jobs WHERE d >= start AND d < "end")),
sh AS (SELECT (SELECT count(*) FROM od) AS dates, (SELECT count(*) FROM jobs) AS n),
m AS (SELECT dates > 0 AND dates < n AS market FROM sh)
SELECT 'market' AS shape, NULL AS key, CAST(d AS VARCHAR) AS start, CAST(d + 1 AS VARCHAR) AS "end" FROM od, m WHERE market
UNION ALL SELECT 'per-key', key, CAST(start AS VARCHAR), CAST("end" AS VARCHAR) FROM pieces, m WHERE NOT market"""


def _shanghai(*clock):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    return datetime(*clock, tzinfo=ZoneInfo("Asia/Shanghai"))


@register(f"""WITH {_PARTS}, {_OPEN}, {_symbols_sql('1998-01-01', '1998-01-20')}, {_CONTINUITY}, {_LIMIT.format(limit=250)}, {_SHAPED}""")
def maintain_complete(spark, sf):
    """Selectors of all customers to requests; the day's window hasn't opened, so its date isn't due."""
    return maintain.plan(
        maintain.COMPLETE, _selectors(spark, sf), (date(1998, 1, 1), date(1998, 1, 21)), _shanghai(1998, 1, 20, 10),
        _part_coverage(spark, sf), _ship_calendar(spark, sf), _nation_weights(spark, sf), row_limit=250,
    ).work


@register(f"""WITH {_PARTS}, {_symbols_sql('1997-06-01', '1998-01-21')},
z AS (SELECT q.*, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS n FROM q)
SELECT 'request' AS what, key, CAST(s + n * 30 AS VARCHAR) AS start, CAST(least(s + n * 30 + 30, e) AS VARCHAR) AS "end" FROM z
  WHERE s + n * 30 < e
UNION ALL SELECT 'outside coverage', q.key, NULL, NULL FROM q LEFT JOIN k ON k.key = q.key WHERE cs IS NULL OR s < cs OR e > ce
UNION ALL SELECT CASE WHEN l IS NULL THEN 'no snapshot before end' ELSE 'no snapshot on or before start' END, r.i, NULL, NULL
  FROM r LEFT JOIN pt ON pt.i = r.i WHERE l IS NULL OR r.u AND f IS NULL
UNION ALL SELECT DISTINCT 'no master row', 'S' || c_nationkey || '.XX', NULL, NULL FROM customer
  WHERE c_nationkey >= 20 AND c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')
UNION ALL SELECT DISTINCT 'invalid selector', 'tushare:S' || c_nationkey || '.XX@199713', NULL, NULL FROM customer
  WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')""")
def maintain_refresh(spark, sf):
    """A covered range again, a month a request, with the keys and selectors that forbid it."""
    masters = table(spark, sf, "nation").where("n_nationkey < 20").select(
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string"), F.lit(".XX")).alias("ts_code")
    )
    made = maintain.plan(
        maintain.REFRESH, _selectors(spark, sf), (date(1997, 6, 1), date(1998, 1, 21)), _shanghai(1998, 3, 1, 12),
        _part_coverage(spark, sf), weights=_nation_weights(spark, sf), masters=masters, row_limit=30,
    )
    none = F.lit(None).cast("date")
    return made.work.select(F.lit("request").alias("what"), "key", "start", "end").unionByName(
        made.problems.select(F.col("problem").alias("what"), F.col("subject").alias("key"), none.alias("start"), none.alias("end"))
    )


@register(f"""WITH {_PARTS}, {_OPEN},
q AS (SELECT key, DATE '1998-01-20' AS s, DATE '1998-01-21' AS e FROM (SELECT key FROM k UNION SELECT '000001.SZ')),
{_CONTINUITY}, {_LIMIT.format(limit=250)}, {_SHAPED}""")
def maintain_update(spark, sf):
    """Today for every covered key and one more, joined up to what is covered."""
    return maintain.plan(
        maintain.UPDATE, ["stored", "000001.SZ"], None, _shanghai(1998, 1, 20, 16),
        _part_coverage(spark, sf), _ship_calendar(spark, sf), row_limit=250,
    ).work


@register(f"""WITH w AS ({WEIGHTS_SQL}),
n AS (SELECT index_code, CAST(date_trunc('month', trade_date) AS DATE) AS m, con_code, trade_date, weight FROM w
  QUALIFY trade_date = max(trade_date) OVER (PARTITION BY index_code, date_trunc('month', trade_date))),
k AS (SELECT index_code, min(m) AS cs, max(m) + INTERVAL 1 MONTH AS ce FROM n WHERE m < DATE '1997-01-01' GROUP BY 1),
a AS (SELECT n.*, m < DATE '1998-11-01' AND (m >= DATE '1996-11-01' AND (cs IS NULL OR m < cs) OR m >= ce OR m = DATE '1998-10-01')
  AS asked FROM n LEFT JOIN k USING (index_code))
SELECT index_code, CAST(m AS VARCHAR) AS effective_month, con_code, CAST(trade_date AS VARCHAR) AS trade_date,
  CAST(weight AS DOUBLE) + CASE WHEN coalesce(asked, FALSE) THEN 0 ELSE 1 END AS weight FROM a
WHERE coalesce(asked, FALSE) OR m < DATE '1997-01-01'""")
def index_month_ingest(spark, sf):
    """Missing months and the current one replaced as a whole; older months keep their rows."""
    now = _shanghai(1998, 10, 5, 12)
    spec = INDEX_WEIGHT
    rows = spec.normalize(data.weights(spark, sf)).select(*spec.columns)
    base = rows.where("effective_month < DATE'1997-01-01'").withColumn("weight", F.col("weight") + 1)
    held = base.groupBy(F.col("index_code").alias("key")).agg(
        F.min("effective_month").alias("start"), F.add_months(F.max("effective_month"), 1).alias("end")
    )
    asked = rows.select(F.col("index_code").alias("key")).distinct().select(
        "key", F.lit(date(1996, 11, 15)).alias("start"), F.lit(date(1998, 10, 20)).alias("end")
    )
    months = work.index_months(asked, held, now)
    answers = rows.join(
        months.select(F.col("key").alias("index_code"), F.col("month").alias("effective_month")), ["index_code", "effective_month"], "left_semi"
    ).select(*spec.columns)
    plan = ingest.index_months(answers, months, spec, held)
    return mutate.apply(base, [plan.mutation], spec)
