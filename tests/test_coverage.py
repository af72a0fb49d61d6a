from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import d, rows
from covspark.operators import coverage as cov
from covspark.operators import intervals, validate
from covspark.spec import COVERAGE_SCHEMA

REQUESTS = "key string, start date, end date"
DAY0 = date(2026, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def spans(spark, items):
    return spark.createDataFrame([(k, day(a), day(b)) for k, a, b in items], REQUESTS)


def test_report(spark):
    covered = spark.createDataFrame([("A", d("07-13"), d("07-18"))], COVERAGE_SCHEMA)
    asked = spark.createDataFrame([("A", d("07-10"), d("07-18")), ("B", d("07-10"), d("07-18"))], REQUESTS)
    out = {r["key"]: r for r in cov.report(asked, covered).collect()}
    assert not out["A"]["complete"]
    assert [tuple(m) for m in out["A"]["missing"]] == [(d("07-10"), d("07-13"))]
    assert out["B"]["covered_start"] is None
    assert [tuple(m) for m in out["B"]["missing"]] == [(d("07-10"), d("07-18"))]


@pytest.mark.parametrize(
    "held, asked, want",
    [
        (None, (3, 5), [(3, 5)]),
        ((1, 9), (3, 5), []),
        ((10, 12), (3, 5), [(3, 10)]),
        ((10, 12), (15, 20), [(12, 20)]),
        ((10, 12), (8, 10), [(8, 10)]),
        ((10, 12), (8, 11), [(8, 10)]),
        ((10, 12), (12, 14), [(12, 14)]),
        ((10, 12), (11, 14), [(12, 14)]),
        ((10, 12), (5, 20), [(5, 10), (12, 20)]),
    ],
)
def test_continuity_cases(spark, held, asked, want):
    coverage = spans(spark, [("A", *held)] if held else [])
    got = cov.continuity_gaps(spans(spark, [("A", *asked)]), coverage)
    assert rows(got, "work_start", "work_end") == [(day(a), day(b)) for a, b in want]


pair = st.tuples(st.integers(0, 30), st.integers(1, 15)).map(lambda t: (t[0], t[0] + t[1]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(pair, pair), min_size=1, max_size=12))
def test_fetching_the_work_keeps_one_interval(spark, cases):
    coverage = spans(spark, [(str(i), *held) for i, (held, _) in enumerate(cases)])
    asked = spans(spark, [(str(i), *want) for i, (_, want) in enumerate(cases)])
    work = cov.continuity_gaps(asked, coverage).selectExpr("key", "work_start as start", "work_end as end")
    after = cov.merge(coverage, work, "error")
    got = {r["key"]: (r["start"], r["end"]) for r in after.collect()}
    for i, (held, want) in enumerate(cases):
        assert got[str(i)] == (day(min(held[0], want[0])), day(max(held[1], want[1])))
    missing = {r["key"] for r in cov.gaps(asked, coverage).collect()}
    inside = {str(i) for i, (h, w) in enumerate(cases) if h[0] <= w[0] and w[1] <= h[1]}
    assert missing == {str(i) for i in range(len(cases))} - inside
    assert cov.gaps(asked, after).isEmpty()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), pair), min_size=1, max_size=15))
def test_interval_union_equals_set_of_days(spark, items):
    df = spans(spark, [(k, *p) for k, p in items])
    got = {}
    for row in intervals.union(df, ["key"]).collect():
        got[row["key"]] = [(r["start"], r["end"]) for r in row["intervals"]]
    for key in {k for k, _ in items}:
        days = {n for k, (a, b) in items if k == key for n in range(a, b)}
        want, at = [], None
        for n in range(0, 60):
            if n in days and at is None:
                at = n
            if n not in days and at is not None:
                want.append((day(at), day(n)))
                at = None
        assert got[key] == want
    all_days = {n for _, (a, b) in items for n in range(a, b)}
    assert rows(intervals.covered_days(df)) == sorted((day(n),) for n in all_days)


def test_merge_over_a_hole(spark):
    held, new = spans(spark, [("A", 0, 4)]), spans(spark, [("A", 59, 60)])
    assert rows(cov.merge(held, new, "hull")) == [("A", day(0), day(60))]
    assert rows(cov.merge(held, new, "keep_left")) == [("A", day(0), day(4))]
    with pytest.raises(Exception, match="hole for key A"):
        cov.merge(held, new, "error").collect()
    assert rows(cov.holes(held, new)) == [("A", 2)]


def test_coverage_contract(spark):
    bad = spark.createDataFrame(
        [("A", d("01-01"), d("01-02")), ("A", d("01-03"), d("01-04")), ("", d("01-01"), d("01-02")),
         ("C", d("01-02"), d("01-02")), ("D", d("01-01"), d("01-02"))], REQUESTS)
    assert [r[0] for r in rows(validate.coverage(bad), "key")] == ["", "A", "C"]


def test_refresh_must_lie_inside(spark):
    held = spans(spark, [("A", 5, 10)])
    asked = spans(spark, [("A", 6, 10), ("A", 4, 6), ("B", 5, 6)])
    assert rows(cov.outside(asked, held), "key", "start") == [("A", day(4)), ("B", day(5))]
