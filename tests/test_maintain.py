"""Maintenance operations from selectors to requests, slices of long ranges, and index months."""

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from conftest import d, rows
from covspark.errors import ContractError, OperandError
from covspark.operators import mutate
from covspark.plans import ingest, maintain, work
from covspark.spec import INDEX_WEIGHT

COVERAGE = "key string, start date, end date"


def clock(day, hour):
    return datetime(2026, 7, day, hour, tzinfo=ZoneInfo("Asia/Shanghai"))


def calendar(spark, first, last, exchanges=("SSE", "SZSE")):
    days = [first + timedelta(days=i) for i in range((last - first).days)]
    return spark.createDataFrame([(x, y, y.weekday() < 5) for x in exchanges for y in days], "exchange string, cal_date date, is_open boolean")


@pytest.fixture
def covered(spark):
    return spark.createDataFrame([("000001.SZ", d("07-06"), d("07-16")), ("600000.SH", d("07-06"), d("07-20"))], COVERAGE)


def test_complete_cuts_the_range_and_asks_for_what_is_missing(spark, covered):
    cal = calendar(spark, d("07-01"), d("08-01"))
    asked = (d("07-06"), d("07-21"))
    made = maintain.plan("complete", ["000001.SZ", "600000.SH"], asked, clock(20, 14), covered, cal)
    assert made.requested == (d("07-06"), d("07-20"))
    assert rows(made.jobs) == rows(made.work, "key", "start", "end") == [("000001.SZ", d("07-16"), d("07-20"))]
    made = maintain.plan("complete", ["000001.SZ", "600000.SH"], asked, clock(20, 15), covered, cal)
    assert made.requested[1] == d("07-21") and made.jobs.count() == 2
    # two open dates against three keys: the whole market, day by day
    keys = ["000001.SZ", "600000.SH", "000002.SZ"]
    made = maintain.plan("complete", keys, (d("07-16"), d("07-18")), clock(20, 15), covered.limit(0), cal)
    assert rows(made.work) == [("market", None, d("07-16"), d("07-17")), ("market", None, d("07-17"), d("07-18"))]
    # a hole in one exchange's calendar, or none at all: per key
    for holed in (cal.where("NOT (exchange = 'SZSE' AND cal_date = DATE'2026-07-16')"), cal.limit(0), None):
        made = maintain.plan("complete", keys, (d("07-16"), d("07-18")), clock(20, 15), covered.limit(0), holed)
        assert {r["shape"] for r in made.work.collect()} == {"per-key"} and made.work.count() == 3


def test_update_is_today_and_may_have_nothing_due(spark, covered):
    made = maintain.plan("update", ["stored"], None, clock(20, 14), covered)
    assert made.requested is None and made.work.isEmpty() and made.problems.isEmpty()
    made = maintain.plan("update", ["stored", "000002.SZ"], None, clock(20, 15), covered)
    assert rows(made.work, "key", "start", "end") == [
        ("000001.SZ", d("07-16"), d("07-21")), ("000002.SZ", d("07-20"), d("07-21")), ("600000.SH", d("07-20"), d("07-21")),
    ]
    assert maintain.plan("update", ["stored"], None, clock(20, 1), covered, use_window=False).requested == (d("07-20"), d("07-21"))
    with pytest.raises(OperandError, match="nothing is due"):
        maintain.plan("complete", ["stored"], (d("07-20"), d("07-21")), clock(20, 14), covered)
    with pytest.raises(OperandError, match="takes no range"):
        maintain.plan("update", ["stored"], (d("07-20"), d("07-21")), clock(20, 15), covered)


def test_refresh_needs_coverage_and_names_bad_operands(spark, covered):
    names = spark.createDataFrame([("000001.SZ",), ("600000.SH",), ("x",), ("all",), ("tushare:000300.SH",)], "selector string")
    masters = spark.createDataFrame([("000905.SH",)], "ts_code string")
    made = maintain.plan("refresh", names, (d("07-10"), d("07-18")), clock(20, 15), covered, masters=masters, row_limit=5)
    assert rows(made.work, "key", "start", "end") == [
        ("000001.SZ", d("07-10"), d("07-15")), ("000001.SZ", d("07-15"), d("07-18")),
        ("600000.SH", d("07-10"), d("07-15")), ("600000.SH", d("07-15"), d("07-18")),
    ]
    assert rows(made.problems) == [
        ("000001.SZ", "outside coverage"), ("000300.SH", "no master row"), ("all", "invalid selector"), ("x", "invalid selector"),
    ]
    assert rows(made.missing) == [("000300.SH",)]
    with pytest.raises(OperandError, match="only for complete"):
        maintain.plan("refresh", ["all"], (d("07-10"), d("07-18")), clock(20, 15), covered)


def test_all_stands_alone_and_needs_a_whole_calendar(spark, covered):
    cal = calendar(spark, d("07-15"), d("07-19"))
    made = maintain.plan("complete", ["all"], (d("07-15"), d("07-19")), clock(20, 15), covered, cal)
    assert [r["start"] for r in made.work.orderBy("start").collect()] == [d("07-15"), d("07-16"), d("07-17")]
    assert made.problems.isEmpty()
    made = maintain.plan("complete", ["all"], (d("07-14"), d("07-19")), clock(20, 15), covered, cal.where("exchange = 'SSE'"))
    assert rows(made.problems) == [("SSE", "calendar incomplete"), ("SZSE", "calendar incomplete")]
    with pytest.raises(OperandError, match="on its own"):
        maintain.plan("complete", ["all", "000001.SZ"], (d("07-15"), d("07-19")), clock(20, 15), covered, cal)


def test_members_of_indexes_become_keys(spark, covered):
    weights = spark.createDataFrame([("000300.SH", d("07-01"), "000001.SZ"), ("000300.SH", d("07-15"), "000009.SZ")], "index_code string, trade_date date, con_code string")
    made = maintain.plan("complete", ["tushare:000300.SH", "tushare:000905.SH@latest"], (d("07-10"), d("07-14")), clock(20, 15), covered.limit(0), weights=weights)
    assert rows(made.symbols) == [("000001.SZ",)]
    assert [r["subject"] for r in made.problems.collect()] == ["000905.SH"]


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_slices_tile_their_jobs(spark, limit):
    first = date(2026, 1, 1)
    at = lambda i: first + timedelta(days=i)
    jobs = [("a", at(0), at(40)), ("a", at(40), at(41)), ("b", at(-30), at(90)), ("c", at(70), at(80)), ("c", at(3), at(3)), ("d", at(-9), at(-5)), (None, at(2), at(9))]
    opened = [at(i) for i in range(60) if at(i).weekday() < 5]
    frame = spark.createDataFrame(jobs + jobs[:1], COVERAGE)
    for cal in (spark.createDataFrame([(x,) for x in opened] * 2, "cal_date date"), None):
        got = sorted((tuple(r) for r in work.sliced(frame, limit, cal).collect()), key=str)
        inside = lambda a, b: sum(a <= x < b for x in opened) if cal is not None else (b - a).days
        for key, start, end in jobs:
            mine = sorted(g[1:] for g in got if g[0] == key and start <= g[1] and g[2] <= end)
            if start == end:
                continue
            assert mine[0][0] == start and mine[-1][1] == end
            assert all(x[1] == y[0] for x, y in zip(mine, mine[1:]))
            assert all(n == inside(a, b) and n <= limit and a < b for a, b, n in mine)
            assert len(mine) == max(1, -(-inside(start, end) // limit))


def test_index_months_are_replaced_whole(spark):
    rows_of = lambda *x: spark.createDataFrame([("I", d(m), c, d(m), float(w)) for m, c, w in x], INDEX_WEIGHT.schema)
    held = spark.createDataFrame([("I", d("05-01"), d("07-01"))], COVERAGE)
    asked = spark.createDataFrame([("I", d("06-03"), d("07-20"))], COVERAGE)
    months = work.index_months(asked, held, clock(20, 12))
    assert rows(months, "month") == [(d("07-01"),)]  # the current month, not in coverage yet
    again = months.unionByName(months.withColumn("month", F.lit(d("06-01"))))
    base = rows_of(("05-01", "a", 1), ("06-01", "a", 1), ("06-01", "b", 1))
    plan = ingest.index_months(rows_of(("06-01", "c", 2)), again, INDEX_WEIGHT, held)
    assert plan.problems.isEmpty() and plan.holes.isEmpty()  # the empty current month is fine
    assert rows(mutate.apply(base, [plan.mutation], INDEX_WEIGHT), "con_code") == [("a",), ("c",)]
    assert rows(plan.coverage, "start", "end") == [(d("05-01"), d("08-01"))]
    early = work.index_months(spark.createDataFrame([("I", d("07-01"), d("08-20"))], COVERAGE), held, clock(20, 12))
    plan = ingest.index_months(rows_of(("06-01", "c", 2)), early, INDEX_WEIGHT, held)
    assert rows(plan.problems, "start", "status") == [(d("06-01"), "not asked for"), (d("08-01"), "before window")]
    with pytest.raises(ContractError):
        plan.publish(type("D", (), {"spec": INDEX_WEIGHT})())
