import random
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from conftest import d, rows
from covspark.errors import ContractError
from covspark.functions.requests import canonical_list, request_key
from covspark.operators import calendar as cal
from covspark.operators import members, ordered
from covspark.plans import batches, ingest, work
from covspark.sources.revisions import Dataset
from covspark.spec import COVERAGE_SCHEMA, DAILY_BASIC, INDEX_BASIC, STOCK_BASIC, TRADE_CAL, DatasetSpec, fields

SHANGHAI = ZoneInfo("Asia/Shanghai")
RANGES = "key string, start date, end date"
DAILY = DatasetSpec(
    "test/daily",
    fields("ts_code string!, trade_date date!, close double"),
    primary_key=("ts_code", "trade_date"),
    partition_key="ts_code",
    time_field="trade_date",
    policy="accept-empty",
    capabilities={"row_limit": 4},
)


def at(day, hour=16):
    return datetime(2026, 7, day, hour, tzinfo=SHANGHAI)


def ranges(spark, *items):
    return spark.createDataFrame([(k, d(a), d(b)) for k, a, b in items], RANGES)


def daily(spark, *items):
    return spark.createDataFrame([(k, d(x), 1.0) for k, x in items], DAILY.schema)


def calendar(spark, first, last):
    days = [d(first) + timedelta(days=i) for i in range((d(last) - d(first)).days)]
    items = [(e, x, x.weekday() < 5, None) for e in ("SSE", "SZSE") for x in days]
    return spark.createDataFrame(items, TRADE_CAL.schema)


def none(spark):
    return spark.createDataFrame([], COVERAGE_SCHEMA)


# due dates and request shape


def test_due_clamp(spark):
    asked = ranges(spark, ("A", "07-17", "07-25"))
    got = work.clamp_due(asked, at(20, 16)).first()
    assert (got["due_end"], got["status"]) == (d("07-21"), "clamped")
    assert work.clamp_due(asked, at(20, 10)).first()["due_end"] == d("07-20")
    today = ranges(spark, ("A", "07-20", "07-21"))
    assert work.clamp_due(today, at(20, 10)).first()["status"] == "not due"
    assert work.clamp_due(today, at(20, 10), use_window=False).first()["status"] == "due"


def test_market_shape_wins_only_when_cheaper(spark):
    days = calendar(spark, "07-10", "07-25")
    two = ranges(spark, ("A", "07-20", "07-21"), ("B", "07-20", "07-21"))
    shape, requests = work.choose_shape(two, cal.open_dates_in(days, two))
    assert shape == "market" and rows(requests, "start") == [(d("07-20"),)]
    one = ranges(spark, ("A", "07-13", "07-21"))
    shape, requests = work.choose_shape(one, cal.open_dates_in(days, one))
    assert shape == "per-key" and rows(requests) == [("A", d("07-13"), d("07-21"))]
    weekend = ranges(spark, ("A", "07-18", "07-20"), ("B", "07-18", "07-20"))
    assert work.choose_shape(weekend, cal.open_dates_in(days, weekend))[0] == "per-key"
    assert work.choose_shape(two, None)[0] == "per-key"


def test_stored_selector(spark):
    held = ranges(spark, ("A", "07-01", "07-02"), ("B", "07-01", "07-02"))
    named = spark.createDataFrame([("stored",), ("C",), ("A",)], "key string")
    assert rows(work.stored_or_explicit(named, held)) == [("A",), ("B",), ("C",)]
    only = spark.createDataFrame([("C",)], "key string")
    assert rows(work.stored_or_explicit(only, held)) == [("C",)]


def test_index_months(spark):
    held = ranges(spark, ("I", "05-01", "07-01"))
    asked = ranges(spark, ("I", "05-10", "07-21"), ("J", "06-30", "07-01"))
    got = rows(work.index_months(asked, held, at(20)), "key", "month", "window")
    assert got == [
        ("I", d("07-01"), "inside-window"),
        ("J", d("06-01"), "after-window"),
    ]
    again = rows(work.index_months(asked, ranges(spark, ("I", "05-01", "08-01")), at(20)), "key", "month")
    assert ("I", d("07-01")) in again
    ahead = work.index_months(ranges(spark, ("I", "08-01", "08-02")), none(spark), at(20))
    assert ahead.first()["window"] == "before-window"


# ingest


def test_market_rows_outside_the_demand_are_dropped(spark):
    jobs = ranges(spark, ("A", "07-20", "07-21"), ("B", "07-20", "07-21"))
    answer = daily(spark, ("A", "07-20"), ("B", "07-20"), ("C", "07-20"))
    days = cal.open_dates(calendar(spark, "07-20", "07-21"))
    plan = ingest.by_date(answer, jobs, days, DAILY, none(spark), at(21))
    assert rows(plan.mutation.rows, "ts_code") == [("A",), ("B",)]
    assert plan.problems.isEmpty()
    assert rows(plan.coverage, "key") == [("A",), ("B",)]


def test_absent_symbol_is_covered_after_the_window(spark):
    jobs = ranges(spark, ("A", "07-17", "07-21"), ("B", "07-17", "07-21"))
    answer = daily(spark, ("A", "07-17"), ("A", "07-20"))
    days = cal.open_dates(calendar(spark, "07-17", "07-21"))
    assert rows(ingest.absent_cells(answer, jobs, days, DAILY)) == [("B", d("07-17")), ("B", d("07-20"))]
    late = ingest.by_date(answer, jobs, days, DAILY, none(spark), at(21))
    assert late.problems.isEmpty() and rows(late.coverage, "key") == [("A",), ("B",)]
    inside = ingest.by_date(answer, jobs, days, DAILY, none(spark), at(20, 16))
    assert rows(inside.problems, "key", "cal_date", "status") == [("B", d("07-20"), "unresolved")]


def test_saturated_date_is_fetched_per_key(spark):
    jobs = ranges(spark, ("A", "07-20", "07-22"), ("B", "07-20", "07-22"))
    full = [(k, "07-20") for k in ("A", "X", "Y", "Z")]
    answer = daily(spark, *full, ("A", "07-21"), ("B", "07-21"))
    days = cal.open_dates(calendar(spark, "07-20", "07-22"))
    plan = ingest.by_date(answer, jobs, days, DAILY, none(spark), at(23))
    assert rows(plan.refetch) == [("A", d("07-20"), d("07-21")), ("B", d("07-20"), d("07-21"))]
    assert rows(plan.problems, "status") == [("refetch needed",)] * 2
    again = daily(spark, ("A", "07-20"), ("B", "07-20"))
    plan = ingest.by_date(answer, jobs, days, DAILY, none(spark), at(23), refetched=again)
    assert plan.problems.isEmpty() and plan.mutation.rows.count() == 4


def test_market_snapshot(spark):
    answer = daily(spark, ("A", "07-20"), ("B", "07-20"), ("A", "07-21"))
    held = ranges(spark, ("A", "07-18", "07-20"), ("B", "07-01", "07-05"))
    plan = ingest.market(answer, DAILY, held, "hull")
    assert rows(plan.coverage) == [("A", d("07-18"), d("07-22")), ("B", d("07-01"), d("07-21"))]
    left = ingest.market(answer, DAILY, held, "keep_left")
    assert rows(left.coverage) == [("A", d("07-18"), d("07-22")), ("B", d("07-01"), d("07-05"))]
    full = daily(spark, *[(k, "07-20") for k in "ABCD"])
    assert not ingest.market(full, DAILY, held, "hull").problems.isEmpty()


@pytest.mark.parametrize(
    "policy, hour, status",
    [("strict", 18, "failure"), ("accept-empty", 18, None), ("accept-empty", 16, "unresolved"),
     ("best-effort", 16, None)],
)
def test_empty_answers(spark, policy, hour, status):
    spec = DatasetSpec(DAILY.name, DAILY.schema, DAILY.primary_key, "ts_code", None, "trade_date", policy)
    jobs = ranges(spark, ("A", "07-20", "07-21"))
    plan = ingest.by_key(daily(spark), jobs, spec, none(spark), at(20, hour))
    assert rows(plan.problems, "status") == ([(status,)] if status else [])
    assert plan.coverage.count() == (0 if policy == "best-effort" else 1)


def test_calendar_refuses_the_future(spark):
    jobs = ranges(spark, ("SSE", "07-20", "07-23"))
    answer = calendar(spark, "07-20", "07-23").where("exchange = 'SSE'")
    plan = ingest.calendar(answer, jobs, TRADE_CAL, none(spark), at(20))
    assert rows(plan.problems, "status") == [("future",)]
    ok = ranges(spark, ("SSE", "07-20", "07-21"))
    assert ingest.calendar(answer.where("cal_date = '2026-07-20'"), ok, TRADE_CAL, none(spark), at(20)).problems.isEmpty()


def test_master_snapshot(spark):
    assert ingest.master_requests(spark).count() == 12
    blank = [None] * len(STOCK_BASIC.columns)
    names = STOCK_BASIC.columns

    def stock(code, status, request, row):
        values = dict(zip(names, blank)) | dict(
            ts_code=code, symbol=code, name=code, exchange="SSE", list_status=status
        )
        return (*values.values(), request, row)

    schema = STOCK_BASIC.schema
    full = spark.createDataFrame(
        [stock("b", "L", 0, 0), stock("a", "L", 0, 1), stock("b", "D", 3, 0)],
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", request_no int, row_no int",
    )
    plan = ingest.snapshot(full, STOCK_BASIC, ["request_no"], ["request_no", "row_no"])
    assert rows(plan.mutation.rows, "ts_code", "list_status") == [("a", "L"), ("b", "D")]
    assert plan.problems.isEmpty()
    cut = ingest.snapshot(full, STOCK_BASIC, ["request_no"], ["request_no", "row_no"], row_limit=2)
    assert rows(cut.problems, "problem") == [("truncated",)]
    empty = ingest.snapshot(full.limit(0), STOCK_BASIC, ["request_no"], ["request_no", "row_no"])
    assert rows(empty.problems, "problem") == [("empty snapshot",)]


def test_exact_metadata_match(spark):
    requests = spark.createDataFrame([(1, "i1"), (2, "i2"), (3, "i3")], "request_id int, wanted string")
    names = INDEX_BASIC.columns
    item = lambda r, c: (r, c, "n", None, "m", *[None] * (len(names) - 4))
    ddl = "request_id int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in INDEX_BASIC.schema)
    answers = spark.createDataFrame([item(1, "i1"), item(2, "other")], ddl)
    plan = ingest.upsert(answers, requests, INDEX_BASIC)
    assert rows(plan.problems, "request_id", "rows") == [(2, 1), (3, 0)]


def test_resume_needs_only_what_is_missing(spark, root):
    dataset = Dataset(spark, root, DAILY)
    first = ranges(spark, ("A", "07-13", "07-18"))
    ingest.by_key(daily(spark, ("A", "07-13")), first, DAILY, none(spark), at(21)).publish(dataset)
    asked = ranges(spark, *[(k, "07-13", "07-18") for k in "ABCD"])
    from covspark.operators.coverage import continuity_gaps

    todo = continuity_gaps(asked, dataset.coverage())
    assert rows(todo, "key") == [("B",), ("C",), ("D",)]
    bad = ingest.by_key(
        daily(spark), ranges(spark, ("B", "07-20", "07-21")), DAILY, dataset.coverage(), at(20, 16)
    )
    with pytest.raises(ContractError):
        bad.publish(dataset)
    assert rows(dataset.refresh().coverage(), "key") == [("A",)]


def test_a_hole_in_coverage_is_not_published(spark, root):
    dataset = Dataset(spark, root, DAILY)
    rows_, later = daily(spark, ("A", "07-13")), daily(spark, ("A", "07-16"))
    ingest.market(rows_, DAILY, none(spark)).publish(dataset)
    plan = ingest.market(later, DAILY, dataset.coverage())
    assert rows(plan.holes) == [("A", 2)]
    with pytest.raises(ContractError, match="hole"):
        plan.publish(dataset)
    ingest.market(later, DAILY, dataset.coverage(), "hull").publish(dataset)
    assert rows(dataset.coverage(), "start", "end") == [(d("07-13"), d("07-17"))]


# membership


@pytest.fixture(scope="module")
def weights(spark):
    items = [("I", "000001.SZ", "05-29"), ("I", "600000.SH", "06-30"), ("I", "600519.SH", "08-03")]
    return spark.createDataFrame([(i, c, d(x)) for i, c, x in items], "index_code string, con_code string, trade_date date")


def request(spark, start, end, selection, index="I"):
    return spark.createDataFrame(
        [(index, d(start), d(end), selection)], "index_code string, start date, end date, selection string"
    )


@pytest.mark.parametrize(
    "start, end, selection, want",
    [("06-29", "07-04", "range_union", ["000001.SZ", "600000.SH"]),
     ("06-30", "07-04", "range_union", ["600000.SH"]),
     ("07-01", "08-03", "range_union", ["600000.SH"]),
     ("07-01", "08-04", "range_union", ["600000.SH", "600519.SH"]),
     ("05-29", "08-04", "range_union", ["000001.SZ", "600000.SH", "600519.SH"]),
     ("01-01", "06-30", "latest", ["000001.SZ"]),
     ("01-01", "07-01", "latest", ["600000.SH"]),
     ("01-01", "07-01", "range_union", []),
     ("01-01", "05-29", "latest", [])],
)
def test_members(spark, weights, start, end, selection, want):
    asked = request(spark, start, end, selection)
    assert [r[0] for r in rows(members.resolve(asked, weights), "symbol")] == want
    assert members.problems(asked, weights).count() == (0 if want else 1)


def test_unknown_index(spark, weights):
    found = members.problems(request(spark, "01-01", "02-01", "latest", "X"), weights)
    assert rows(found, "status") == [("no snapshot before end",)]


def test_selectors_expand(spark, weights):
    w = weights.withColumn("index_code", F.lit("000300.SH"))
    expand = lambda *s: [
        r[0]
        for r in rows(
            members.expand_selectors(
                spark.createDataFrame([(x,) for x in s], "selector string"), w, (d("06-29"), d("07-04"))
            )
        )
    ]
    assert expand("tushare:000300.SH") == ["000001.SZ", "600000.SH"]
    assert expand("tushare:000300.SH@latest", "000002.SZ") == ["000002.SZ", "600000.SH"]
    assert expand("tushare:000300.SH@202606") == ["600000.SH"]
    assert expand("tushare:000300.SH@latest", "tushare:000300.SH") == ["000001.SZ", "600000.SH"]


# batches, positions, request keys


@pytest.mark.parametrize("n, limit, chunk", [(4, 100, 4), (4, 30, 5), (64, 50, 64), (3, 10**9, 7), (1, 5, 1)])
def test_batches_by_size_equal_the_loop(spark, n, limit, chunk):
    random.seed(n * limit)
    sizes = [random.choice([0, 1, 5, 9, 20, 120]) for _ in range(90)]
    items = [("a", i, s) for i, s in enumerate(sizes)] + [("b", i, s) for i, s in enumerate(sizes[::-1][:33])]
    df = spark.createDataFrame(items, "g string, i int, size int")
    got = {
        (r["g"], r["i"]): r["batch"]
        for r in batches.by_size(df, ["g"], ["i"], F.floor(F.col("i") / 10), "size", n, limit, chunk).collect()
    }
    want = {}
    for group in "ab":
        batch = count = total = 0
        for _, i, size in [x for x in items if x[0] == group]:
            want[group, i] = batch
            count, total = count + 1, total + size
            if count >= n or total >= limit:
                batch, count, total = batch + 1, 0, 0
    assert got == want


@pytest.mark.parametrize("n, limit", [(2, 15), (3, 40)])
def test_chunk_maps_fold_in_a_tree(spark, monkeypatch, n, limit):
    """Chunks of n items under nodes of four maps, three levels high."""
    monkeypatch.setattr(batches, "FAN", 4)
    test_batches_by_size_equal_the_loop(spark, n, limit, n)


def test_hot_group_windows_match_plain_ones(spark):
    random.seed(7)
    items = [("hot" if random.random() < 0.7 else random.choice("abc"), i, random.choice("xxy")) for i in range(400)]
    df = spark.createDataFrame(items, "k string, i int, v string")
    bucket = F.floor(F.col("i") / 7)
    place = {(r["k"], r["i"]): r["position"] for r in ordered.position(df, ["k"], ["i"], bucket).collect()}
    run = {(r["k"], r["i"]): r["run"] for r in ordered.runs(df, ["k"], ["i"], bucket, ["v"]).collect()}
    for key in {k for k, _, _ in items}:
        last, number = None, 0
        for at_, (_, i, v) in enumerate([x for x in items if x[0] == key], start=1):
            number += v != last
            last = v
            assert place[key, i] == at_ and run[key, i] == number
    best = ordered.top_n(df, ["k"], [F.col("i").desc()], 3)
    for key in {k for k, _, _ in items}:
        want = sorted((i for k, i, _ in items if k == key), reverse=True)[:3]
        assert [r["i"] for r in best.where(F.col("k") == key).orderBy("rank").collect()] == want


def test_range_bucket_is_monotone(spark):
    df = spark.range(1000)
    out = df.withColumn("b", ordered.range_bucket(df, "id", 8)).orderBy("id").collect()
    found = [r["b"] for r in out]
    assert found == sorted(found) and 4 <= len(set(found)) <= 8


def test_request_keys(spark):
    df = spark.createDataFrame(
        [("complete", ["b", "a", "b"]), ("complete", ["a", "b"]), ("update", ["a"])], "op string, s array<string>"
    )
    key = request_key(F.lit("x/y"), F.col("op"), {"symbols": canonical_list(F.col("s")), "at": F.lit(None).cast("string")})
    got = [r[0] for r in df.select(key).collect()]
    assert got[0] == got[1] == '{"dataset":"x/y","operands":{"at":null,"symbols":["a","b"]},"operation":"complete"}'
    assert got[2] is None


def test_daily_basic_limits():
    assert DAILY_BASIC.capabilities["row_limit"] == 6000 and DAILY_BASIC.policy == "accept-empty"
    assert work.due_end(at(20, 15)) == date(2026, 7, 21)


def test_batches_of_null_keys_and_bad_sizes(spark):
    from covspark.plans import batches

    items = spark.createDataFrame([(None, 1, 5), (None, 2, 5), ("a", 1, 5), ("a", 2, 5)], "k string, i int, z long")
    out = batches.by_size(items, ["k"], ["i"], F.lit(0), "z", n=4, limit=5)
    assert rows(out, "k", "i", "batch") == [("a", 1, 0), ("a", 2, 1), (None, 1, 0), (None, 2, 1)]
    numbered = spark.createDataFrame([(None, 1, 5), (7, 1, 5), (None, 2, 5)], "k long, i int, z long")
    assert batches.by_size(numbered, ["k"], ["i"], F.lit(0), "z").count() == 3
    for z in (None, -1):
        bad = items.unionByName(spark.createDataFrame([("b", 1, z)], items.schema))
        assert batches.bad_sizes(bad, "z").count() == 1
        with pytest.raises(Exception, match="null or negative size"):
            batches.by_size(bad, ["k"], ["i"], F.lit(0), "z").collect()
