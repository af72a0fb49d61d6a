import json
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from conftest import d, rows
from covspark.functions import dates
from covspark.functions.selectors import parse_selector
from covspark.operators import calendar as cal
from covspark.sources import envelope, jsonl
from covspark.spec import (
    DAILY_BASIC,
    INDEX_BASIC,
    INDEX_WEIGHT,
    STOCK_BASIC,
    TRADE_CAL,
    check_name,
)

SHANGHAI = ZoneInfo("Asia/Shanghai")


def responses(spark, *bodies):
    texts = [(str(i), b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(texts, "request_id string, response string")


def answer(names, items, code=0, msg=None):
    return {"code": code, "msg": msg, "data": {"fields": list(names), "items": items}}


def test_calendar_rows(spark):
    names = ["cal_date", "exchange", "is_open", "pretrade_date", "unknown"]
    body = answer(names, [["20260720", "SSE", 1, "20260717", 9], ["20260718", "SSE", "0", None, 9]])
    good, bad, _ = envelope.table_from_responses(responses(spark, body), TRADE_CAL)
    assert good.columns == TRADE_CAL.columns
    assert rows(good) == [("SSE", d("07-18"), False, None), ("SSE", d("07-20"), True, d("07-17"))]
    assert bad.isEmpty()


def test_flag_is_only_true_for_one(spark):
    values = [1, "1", "1.0", 1.0, None, True, "0"]
    items = [["SSE", f"202607{i + 10}", v, ""] for i, v in enumerate(values)]
    good, *_ = envelope.table_from_responses(
        responses(spark, answer(TRADE_CAL.columns, items)), TRADE_CAL
    )
    flags = [r["is_open"] for r in good.orderBy("cal_date").collect()]
    assert flags == [True, True, False, False, False, False, False]


def test_json_kinds(spark):
    """What the number, text or flag of a cell may fill."""
    names = DAILY_BASIC.columns
    fine = dict.fromkeys(names) | {"ts_code": "000001.SZ", "trade_date": "20260720"}
    bad = [("limit_status", v) for v in ("5.0", "5.", "x", 200, 1e40, 10**30, [5], {"a": 5})]
    bad += [("trade_date", 20260720), ("trade_date", True), ("ts_code", 1), ("ts_code", 1.5), ("ts_code", False), ("close", [1]), ("close", {})]
    good = [("close", v, w) for v, w in [(1.0, 1.0), (2, 2.0), (True, 1.0), ("2.5", 2.5), (1e300, 1e300), (10**30, 1e30)]]
    good += [("limit_status", v, w) for v, w in [(5, 5), ("5", 5), (" +5 ", 5), (5.0, 5), (5.7, 5), (-5.7, -5), (True, 1), ("", None), (None, None)]]
    items = [list((fine | {n: v}).values()) for n, v, *_ in [*bad, *good]]
    bodies = responses(spark, answer(names, [*items, list((fine | {"ts_code": None}).values())]))
    read = envelope.normalize(envelope.explode_items(envelope.classify(bodies), DAILY_BASIC), DAILY_BASIC)
    found = read.orderBy("row_no").collect()
    for row, (name, _) in zip(found, bad):
        assert row["violations"] == [f"{name}: bad value"] and row[name] is None
    for row, (name, _, want) in zip(found[len(bad) :], good):
        assert row["violations"] == [] and row[name] == want
    assert found[-1]["violations"] == ["ts_code: required"]


def test_plain_text_columns(spark):
    df = spark.createDataFrame([("SSE", "20260720", "1", None), ("SSE", "2026", "1.0", "")], "exchange string, cal_date string, is_open string, pretrade_date string")
    out = envelope.normalize(df, TRADE_CAL)
    assert sorted((r["is_open"], *r["violations"]) for r in out.collect()) == [(False, "cal_date: bad value"), (True,)]


@pytest.mark.parametrize(
    "text, want",
    [("20260720", d("07-20")), ("20260720 00:00", d("07-20")), ("2026072", None), ("20260230", None),
     ("2026-07-20", None), ("", None), (None, None)],
)
def test_provider_dates(spark, text, want):
    names = INDEX_BASIC.columns
    item = ["i", "n", None, "m"] + [None] * 3 + [text] + [None] * 5
    good, bad, _ = envelope.table_from_responses(responses(spark, answer(names, [item])), INDEX_BASIC)
    if want is None and text not in ("", None):
        assert bad.first()["violations"] == ["base_date: bad value"]
    else:
        assert good.first()["base_date"] == want


def test_daily_numbers(spark):
    names = DAILY_BASIC.columns
    item = ["000001.SZ", "20260720", "1.5", "", None, 2, "1e3", " 7 ", ".5", "-3", "5."] + ["0"] * 7 + ["3"]
    assert len(item) == len(names)
    good, bad, _ = envelope.table_from_responses(responses(spark, answer(names, [item])), DAILY_BASIC)
    row = good.first()
    assert bad.isEmpty()
    assert [row[n] for n in names[2:11]] == [1.5, None, None, 2.0, 1000.0, 7.0, 0.5, -3.0, 5.0]
    assert row["limit_status"] == 3
    for text in ("1_0", "1.0d", "abc", "1,5"):
        item[2] = text
        _, bad, _ = envelope.table_from_responses(responses(spark, answer(names, [item])), DAILY_BASIC)
        assert bad.first()["violations"] == ["close: bad value"]
    item[2], item[-1] = "1", "200"
    _, bad, _ = envelope.table_from_responses(responses(spark, answer(names, [item])), DAILY_BASIC)
    assert bad.first()["violations"] == ["limit_status: bad value"]


def test_required_ragged_and_repeated_fields(spark):
    names = ["exchange", "cal_date", "is_open", "pretrade_date", "exchange"]
    body = answer(names, [["X", "20260720", 1, None, "SSE"], [None, "", 1, None, None], ["SSE"]])
    good, bad, _ = envelope.table_from_responses(responses(spark, body), TRADE_CAL)
    assert rows(good, "exchange") == [("SSE",)]
    found = sorted(tuple(r["violations"]) for r in bad.collect())
    assert ("exchange: required", "cal_date: required") in found
    assert any("ragged item" in v for v in found)


def test_protocol_errors(spark):
    bodies = ["[1]", "nope", {}, {"code": "0"}, {"code": 40001, "msg": "quota"}, {"code": 0, "data": None},
              {"code": 0, "data": {"fields": []}}, answer(["exchange"], [])]
    found = envelope.response_problems(
        envelope.classify(responses(spark, *bodies)), TRADE_CAL, "request_id"
    )
    assert [r[1] for r in rows(found, "request_id", "problem")] == [
        "not an object", "not json", "code missing or invalid", "code missing or invalid",
        "provider error", "data missing or invalid", "fields or items missing",
        "missing fields: cal_date, is_open, pretrade_date",
    ]


def test_index_weight_keeps_latest_date_of_month(spark):
    items = [["I", c, day, w] for day, c, w in [
        ("20260601", "a", 1), ("20260630", "a", 2), ("20260630", "b", 3), ("20260701", "c", 4)]]
    good, *_ = envelope.table_from_responses(
        responses(spark, answer(INDEX_WEIGHT.provided, items)), INDEX_WEIGHT
    )
    assert good.columns == INDEX_WEIGHT.columns
    assert rows(good) == [
        ("I", d("06-01"), "a", d("06-30"), 2.0),
        ("I", d("06-01"), "b", d("06-30"), 3.0),
        ("I", d("07-01"), "c", d("07-01"), 4.0),
    ]


def test_specs():
    assert len(STOCK_BASIC.columns) == 17 and len(DAILY_BASIC.columns) == 19
    assert STOCK_BASIC.required == ["ts_code", "symbol", "name", "exchange", "list_status"]
    for bad in ("x", "a/b/c", "A/b", "a/1b", "a/", ""):
        with pytest.raises(ValueError):
            check_name(bad)


@pytest.mark.parametrize(
    "clock, target, want",
    [((20, 14, 59), "07-20", "before-window"), ((20, 15, 0), "07-20", "inside-window"),
     ((20, 17, 0), "07-20", "after-window"), ((20, 8, 0), "07-19", "after-window"),
     ((20, 23, 0), "07-21", "before-window")],
)
def test_daily_window(spark, clock, target, want):
    now = datetime(2026, 7, clock[0], clock[1], clock[2], tzinfo=SHANGHAI).astimezone(timezone.utc)
    assert spark.range(1).select(dates.daily_window(F.lit(d(target)), now)).first()[0] == want


def test_window_needs_a_zone():
    with pytest.raises(ValueError):
        dates.market_time(datetime(2026, 7, 20, 12))


def test_monthly_window(spark):
    now = datetime(2026, 7, 20, 12, tzinfo=SHANGHAI)
    got = [
        spark.range(1).select(dates.monthly_window(F.lit(d(t)), now)).first()[0]
        for t in ("06-15", "07-31", "08-01")
    ]
    assert got == ["after-window", "inside-window", "before-window"]


def test_range_text(spark):
    texts = ["2026-06-01:today", "", "2026-06-01", "20260101:20260201", "2026-02-01:2026-01-01", "a:b:c", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = dates.parse_ranges(df, "text", d("07-20")).collect()
    assert (out[0]["start"], out[0]["end"], out[0]["status"]) == (d("06-01"), d("07-20"), None)
    assert all(r["status"] and r["start"] is None for r in out[1:])


def test_selectors(spark):
    cases = {
        "000001.SZ": ("security", "000001.SZ", None),
        "tushare:000300.SH": ("index", "000300.SH", "range"),
        "tushare:000300.SH@latest": ("index", "000300.SH", "latest"),
        "tushare:000300.SH@202606": ("index", "000300.SH", "202606"),
        "tushare:000300.SH@202613": ("invalid", None, None),
        "tushare:000300@latest": ("invalid", None, None),
        "000001.XX": ("invalid", None, None),
        "stored": ("stored", None, None),
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    for row in df.select("s", parse_selector(F.col("s")).alias("p")).collect():
        assert tuple(row["p"]) == cases[row["s"]]


def test_previous_open_date_matches_the_formula(spark):
    first = date(2026, 7, 1)
    days = [first + timedelta(days=i) for i in range(40)]
    last, items = date(2026, 6, 30), []
    for x in days:
        items.append(("SSE", x, x.weekday() < 5, last))
        if x.weekday() < 5:
            last = x
    df = spark.createDataFrame(items, TRADE_CAL.schema)
    assert cal.pretrade_mismatches(df).isEmpty()
    assert cal.previous_open(df).where("derived_pretrade_date is null").count() == 1


def test_jsonl_skips_bad_lines(spark, root):
    with open(f"{root}/log.jsonl", "w") as f:
        f.write('{"type":"diagnostic","time":1,"message":"m","severity":"error","code":"c"}\n')
        f.write('{"message":"plain","severity":"x"}\nnot json\n[1]\n{"type":"log"}\n')
    records = jsonl.read(spark, f"{root}/log.jsonl", jsonl.LOG_LINES)
    assert rows(jsonl.task_lines(records), "type", "message", "severity", "count") == [
        ("log", "plain", None, None), ("task.diagnostic", "m", "error", 1)]
    counted = jsonl.parse(spark.read.text(f"{root}/log.jsonl"), jsonl.LOG_LINES)
    assert counted.where("skipped").count() == 2


def test_refused_responses_are_returned(spark):
    bodies = ['{"code": 5, "msg": "no"}', "not json", '{"code": 0, "data": {"fields": ["cal_date"], "items": []}}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, response string")
    good, bad, refused = envelope.table_from_responses(df, TRADE_CAL, "id")
    assert good.isEmpty() and bad.isEmpty()
    assert sorted(r.id for r in refused.collect()) == [0, 1, 2]
