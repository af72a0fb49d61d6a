import pytest
from pyspark.sql import functions as F

from conftest import rows
from covspark.operators import logs

EVENTS = "event_id string, timestamp double, kind string, severity string, message string, reference string"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [("e1", 1.0, "task", "error", "a", None), ("e2", 2.0, "task", "warning", "b", None),
         ("e3", 3.0, None, "error", "c", None), ("k1", 4.0, "acknowledgement", "info", "", "e1"),
         ("k2", 5.0, "acknowledgement", "info", "", "e1"), ("k3", 6.0, "acknowledgement", "info", "", "gone")],
        EVENTS)


def test_listing(events):
    assert [r["event_id"] for r in logs.list_events(events).collect()] == ["e3", "e2", "e1"]
    assert [r["event_id"] for r in logs.list_events(events, unread=True).collect()] == ["e3", "e2"]
    assert [r["event_id"] for r in logs.list_events(events, severity="error", since=1.0).collect()] == ["e3", "e1"]
    assert logs.list_events(events).where("acknowledged").count() == 1
    with pytest.raises(ValueError):
        logs.list_events(events, severity="loud")


HANDLES = "handle_id string, execution_id string, dataset string, status string, created_at double, updated_at double"


@pytest.fixture(scope="module")
def handles(spark):
    return spark.createDataFrame(
        [("h1", "x1", "d", "succeeded", 1.0, 5.0), ("h2", "x1", "d", "queued", 2.0, 9.0),
         ("h3", "x2", "d", "failed", 3.0, 7.0), ("h4", "x3", "d", "canceled", 4.0, 7.0),
         ("h5", "x4", "e", "running", 5.0, 1.0)], HANDLES)


def test_tasks(spark, handles):
    assert rows(logs.newest_terminal(handles), "dataset", "handle_id") == [("d", "h3")]
    assert rows(logs.retained(handles, 2), "handle_id") == [("h2",), ("h3",), ("h4",), ("h5",)]
    kept = logs.retained(handles, 1)
    executions = spark.createDataFrame([("x1", "d", "queued"), ("x2", "d", "failed"), ("x3", "d", "waiting"),
                                        ("x4", "e", "running")], "execution_id string, dataset string, status string")
    assert rows(logs.retained_executions(executions, kept), "execution_id") == [("x1",), ("x2",), ("x4",)]
    assert rows(logs.subscribers(handles, executions)) == [("x1", 1), ("x2", 0), ("x3", 0), ("x4", 1)]
    assert rows(logs.queue_lengths(executions)) == [("d", 1, 1), ("e", 0, 1)]
    assert [r["handle_id"] for r in logs.list_handles(handles, dataset="d").collect()] == ["h4", "h3", "h2", "h1"]


DIAGNOSTICS = ("execution_id string, position int, severity string, code string, message string, "
               "context string, count int")  # fmt: skip


def test_diagnostics(spark, handles):
    items = [("x1", 0, "warning", "c", "m0", None, 2), ("x1", 1, "warning", "c", "m0", None, 3),
             ("x1", 2, "info", "c", "m", None, 9), ("x1", 3, "error", "c", "m", None, 0)]
    items += [("x1", 10 + i, "error", "c", f"e{i}", None, 1) for i in range(12)]
    df = spark.createDataFrame(items, DIAGNOSTICS)
    assert rows(logs.diagnostic_totals(df)) == [("x1", 5, 12)]
    assert rows(logs.handle_totals(df, handles), "handle_id", "warnings") == [("h1", 5), ("h2", 5)]
    shown = logs.visible_diagnostics(df)
    assert shown.count() == 10 and shown.where("severity = 'warning'").first()["shown_count"] == 2
    left = logs.suppressed_diagnostics(df)
    assert rows(left, "severity", "suppressed") == [("error", 3), ("warning", 3)]


def test_collapsed_lines(spark):
    items = list(enumerate(["a", "a", "b", "b", "b", "a", "c", "c"]))
    df = spark.createDataFrame([("x", i, v, float(i)) for i, v in items], "x string, i int, text string, time double")
    for width in (1, 2, 3, 100):
        out = logs.collapse_lines(df, ["x"], ["i"], F.floor(F.col("i") / width), ["text"], "time")
        got = [(r["text"], r["count"], r["first_time"]) for r in out.orderBy("run").collect()]
        assert got == [("a", 2, 0.0), ("b", 3, 2.0), ("a", 1, 5.0), ("c", 2, 6.0)]


def test_line_text(spark):
    df = spark.createDataFrame(
        [("log", None, None, "hello", None), ("task.diagnostic", "warning", "c", "m", 3),
         ("task.diagnostic", "error", None, "m", 1)],
        "type string, severity string, code string, message string, count int")
    text = logs.line_text(*[F.col(c) for c in df.columns])
    assert [r[0] for r in df.select(text).collect()] == ["hello", "[warning] c: m (×3)", "[error] : m"]


def test_timeline_and_eta(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (101.0,), (-1.0,)], "created_at double")
    assert rows(logs.timeline(df, 100.0, 100.0), "x") == [(0.0,), (0.5,), (1.0,)]
    df = spark.createDataFrame([(10.0, 1, 5), (10.0, 0, 5), (10.0, 5, 5)], "e double, c int, t int")
    assert [r[0] for r in df.select(logs.eta(F.col("e"), F.col("c"), F.col("t"))).collect()] == [40.0, None, None]


def test_id_prefixes(spark):
    ids = spark.createDataFrame([("abcdef0123456789",), ("abcdef01ff",), ("abcdef01",), ("12",)], "id string")
    asked = ["abcdef01", "abcdef012", "abcdef01f", "abcdef0", "12", "99999999", "ABCDEF01", "", "abcdef0123456789"]
    operands = spark.createDataFrame([(a,) for a in asked], "operand string")
    got = {r["operand"]: (r["status"], r["id"]) for r in logs.resolve_prefixes(operands, ids).collect()}
    assert got == {
        "abcdef01": ("exact", "abcdef01"),
        "abcdef012": ("prefix", "abcdef0123456789"),
        "abcdef01f": ("prefix", "abcdef01ff"),
        "abcdef0": ("too short", None),
        "12": ("exact", "12"),
        "99999999": ("not found", None),
        "ABCDEF01": ("invalid", None),
        "": ("invalid", None),
        "abcdef0123456789": ("exact", "abcdef0123456789"),
    }
    more = spark.createDataFrame([("aaaaaaaa11",), ("aaaaaaaa22",)], "id string")
    one = spark.createDataFrame([("aaaaaaaa",)], "operand string")
    assert rows(logs.resolve_prefixes(one, more), "status") == [("ambiguous",)]


def test_prefixes_like_counting(spark):
    """Shared heads, ids in later buckets and ids that are prefixes of others, against counting by hand."""
    import random

    r = random.Random(4)
    heads = ["abcdef01", "abcdef02", "00000000"]
    ids = {r.choice(heads) + "".join(r.choice("0f") for _ in range(r.choice([0, 1, 4, 5, 9]))) for _ in range(60)} | {"12", "ffffffffffff"}
    asked = {x[: r.randrange(6, len(x) + 1)] for x in ids for _ in range(3) if len(x) > 6} | {h + s for h in heads for s in ("", "0f0", "0000", "ffff0")} | {None, "zz"}
    found = logs.resolve_prefixes(
        spark.createDataFrame([(a,) for a in asked] * 2, "operand string"), spark.createDataFrame([(i,) for i in ids] * 2 + [(None,)], "id string")
    )
    want = {}
    for a in asked:
        near = [i for i in ids if a and i.startswith(a)]
        if a is None or a == "zz":
            want[a] = ("invalid", None)
        elif a in ids:
            want[a] = ("exact", a)
        elif len(a) < 8:
            want[a] = ("too short", None)
        else:
            want[a] = ("prefix", near[0]) if len(near) == 1 else ("ambiguous" if near else "not found", None)
    assert {x["operand"]: (x["status"], x["id"]) for x in found.collect()} == want
    assert {"ambiguous", "not found", "prefix", "exact"} <= {s for s, _ in want.values()}
