import json
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from conftest import d, rows
from covspark.errors import ContractError
from covspark.sources.revisions import Dataset
from covspark.spec import INDEX_DAILY
from covspark.streaming import activity, coverage, events, ingest, sinks

NOW = datetime(2026, 7, 25, 12, tzinfo=ZoneInfo("Asia/Shanghai"))


def land(folder, name, *answers):
    with open(f"{folder}/{name}", "w") as f:
        for key, start, end, days in answers:
            items = [[key, x, *["1.5"] * 9] for x in days]
            body = {"code": 0, "data": {"fields": INDEX_DAILY.columns, "items": items}}
            f.write(json.dumps({
                "request_id": f"{key}/{start}", "key": key, "start": f"2026-{start}", "end": f"2026-{end}",
                "response": json.dumps(body)}) + "\n")


def run(spark, root, dataset):
    ingest.start(
        ingest.read_landed(spark, f"{root}/landed", 1), dataset, f"{root}/state", "feed", lambda: NOW
    ).awaitTermination()


def test_landed_files_become_revisions(spark, root):
    import os

    os.makedirs(f"{root}/landed")
    dataset = Dataset(spark, f"{root}/data", INDEX_DAILY)
    land(f"{root}/landed", "1.json", ("A", "07-13", "07-16", ["20260713", "20260714"]))
    run(spark, root, dataset)
    assert rows(dataset.refresh().coverage()) == [("A", d("07-13"), d("07-16"))]
    land(f"{root}/landed", "2.json", ("A", "07-16", "07-18", ["20260716"]), ("B", "07-13", "07-14", ["20260713"]))
    run(spark, root, dataset)
    assert rows(dataset.refresh().coverage(), "key", "end") == [("A", d("07-18")), ("B", d("07-14"))]
    assert dataset.scan().count() == 4 and dataset.manifest.revision == 2
    # the same micro-batch again is a no-op
    landed = spark.read.schema(ingest.LANDED).json(f"{root}/landed/2.json")
    same = ingest.publish_batch(landed, 1, dataset, "feed", NOW)
    assert same == dataset.manifest.publication_id and dataset.refresh().manifest.revision == 2


def test_bad_responses_publish_nothing(spark, root):
    dataset = Dataset(spark, root, INDEX_DAILY)

    def batch(response):
        return spark.createDataFrame(
            [("r", "A", d("07-13"), d("07-14"), response, None, None, None)], ingest.LANDED
        )

    good = {"code": 0, "data": {"fields": INDEX_DAILY.columns, "items": [["A", "20260713", *["x"] * 9]]}}
    empty = {"code": 0, "data": {"fields": INDEX_DAILY.columns, "items": []}}
    for body in ("oops", json.dumps(good), json.dumps(empty)):
        with pytest.raises(ContractError):
            ingest.publish_batch(batch(body), 0, dataset, "feed", NOW)
    assert dataset.refresh().manifest is None


def test_newest_answer_wins_and_foreign_rows_fail(spark, root):
    dataset = Dataset(spark, root, INDEX_DAILY)

    def answer(key, *days):
        items = [[key, f"2026{x}", *["1"] * 9] for x in days]
        return json.dumps({"code": 0, "data": {"fields": INDEX_DAILY.columns, "items": items}})

    twice = spark.createDataFrame(
        [("r9", "A", d("07-13"), d("07-15"), answer("A", "0713"), 9, 0, 1),
         ("r10", "A", d("07-13"), d("07-15"), answer("A", "0713"), 10, 1, 2),
         ("r10", "A", d("07-13"), d("07-15"), answer("A", "0714"), 10, 2, 2),
         ("r10", "A", d("07-13"), d("07-15"), answer("A", "0714"), 10, 2, 2)],
        ingest.LANDED,
    )
    ingest.publish_batch(twice, 0, dataset, "feed", NOW)
    assert dataset.refresh().scan().count() == 2
    with pytest.raises(ContractError, match="parts missing"):
        ingest.publish_batch(twice.where("part < 2"), 1, dataset, "feed", NOW)
    mixed = spark.createDataFrame(
        [("r3", "A", d("07-15"), d("07-16"), answer("B", "0715"), 1, 0, 1), ("r4", "B", d("07-15"), d("07-16"), answer("B", "0715"), 1, 0, 1)],
        ingest.LANDED,
    )
    with pytest.raises(ContractError, match="outside their request"):
        ingest.publish_batch(mixed, 1, dataset, "feed", NOW)


class State:
    """What ``settle``'s function sees of Spark's group state."""

    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_settling_waits_for_parts_and_times_out(monkeypatch):
    import pandas as pd

    class Landed:
        def groupBy(self, *names):
            return self

        def applyInPandasWithState(self, run, *_):
            return run

    settle, state, request = ingest.settle(Landed(), 10, 99), State(), ("A", d("07-13"), d("07-15"))

    def feed(*parts):
        frame = pd.DataFrame([(a, p, n, f"{a}/{p}", f"r{a}") for a, p, n in parts], columns=["arrival", "part", "parts", "response", "request_id"])
        out = pd.concat(list(settle(request, iter([frame]), state)))
        return sorted((r.status, int(r.arrival), int(r.part), r.response) for r in out.itertuples())

    assert feed((9, 0, 2)) == [] and state.timeout == 10
    assert feed((9, 1, 2), (9, 1, 2)) == [("complete", 9, 0, "9/0"), ("complete", 9, 1, "9/1")] and state.timeout == 99
    assert feed((9, 1, 2), (3, 0, 1)) == [("late", 3, 0, None), ("late", 9, 1, None)]
    assert feed((10, 0, 2)) == []
    assert feed((11, 0, 1), (12, 0, 1)) == [("complete", 12, 0, "12/0"), ("late", 10, 0, None), ("late", 11, 0, None)]
    assert feed((13, 0, 2)) == []
    state.hasTimedOut = True
    (left,) = settle(request, iter([]), state)
    assert left[["status", "arrival", "parts"]].values.tolist() == [["incomplete", 13, 2]]
    assert state.value[0] == 12 and state.timeout == 99
    assert next(settle(request, iter([]), state)).empty and state.value is None


def test_requests_are_settled_by_tables(spark, root, monkeypatch):
    """The same answers and state as ``settle`` over random batches with timeouts, without a Python call per request."""
    import random

    import pandas as pd

    class Landed:
        groupBy = lambda self, *names: self
        applyInPandasWithState = lambda self, run, *_: run

    rng = random.Random(6)
    settle, states, due = ingest.settle(Landed(), 10, 99), {}, {}
    state = spark.createDataFrame([], ingest.REQUESTS)
    requests = [(k, d("07-13"), d("07-15")) for k in ("A", "B", "C", "D", "E", None)]
    columns = ["request_id", "key", "start", "end", "response", "arrival", "part", "parts"]
    seen = set()
    for batch, now in enumerate((0, 5, 9, 16, 40, 41, 47, 160, 165)):
        landed = []
        for request in requests:
            if rng.random() < 0.6:
                for _ in range(rng.randint(1, 5)):
                    arrival, of = rng.randint(1 + batch // 2, 4 + batch), rng.randint(1, 3)
                    landed.append((f"r{rng.randint(0, 9)}", *request, rng.choice(["x", "y", None]), arrival, rng.randrange(of), of))
        wanted = []
        for request in requests:
            own = pd.DataFrame([x for x in landed if x[1:4] == request], columns=columns, dtype=object)
            held = states.setdefault(request, State())
            held.hasTimedOut = own.empty
            if own.empty and not (held.exists and due[request] <= now):
                continue
            wanted += pd.concat(list(settle(request, iter([] if own.empty else [own]), held)))[columns + ["status"]].values.tolist()
            due[request] = now + held.timeout
        answers, after = ingest.settled(spark.createDataFrame(landed, ingest.LANDED), state, now, 10, 99)
        after.write.parquet(f"{root}/state-{batch}")
        state = spark.read.parquet(f"{root}/state-{batch}")
        plain = lambda x: None if x is None or x != x else x
        # the id shown for an answer that was given up is that of any of its parts
        key = lambda r: tuple(str(plain(x)) for x in r[(r[-1] == "incomplete") :])
        assert sorted(map(key, ([r[c] for c in columns] + [r.status] for r in answers.collect()))) == sorted(map(key, wanted))
        seen |= {r[-1] for r in wanted}
        live = {x: s.value for x, s in states.items() if s.exists}
        got = {(r.key, r.start, r.end): (r.done, r.arrival, r.parts, sorted(p.part for p in r.held)) for r in state.collect()}
        assert got == {x: (v[0], v[1], v[2], sorted(v[3])) for x, v in live.items()}
    assert seen == {"complete", "late", "incomplete"}


def test_a_stream_settles_without_python(spark, root, monkeypatch):
    """A call per request took most of the time of streams of many requests."""
    import os

    os.makedirs(f"{root}/landed")
    monkeypatch.setattr(ingest, "settle", None)
    dataset = Dataset(spark, f"{root}/data", INDEX_DAILY)
    body = {"code": 0, "data": {"fields": INDEX_DAILY.columns, "items": [["A", "20260713", *["1"] * 9]]}}
    for part, text in enumerate((body, {**body, "data": {**body["data"], "items": []}})):
        with open(f"{root}/landed/{part}.json", "w") as f:
            f.write(json.dumps({"request_id": "r", "key": "A", "start": "2026-07-13", "end": "2026-07-14", "arrival": 1, "part": part, "parts": 2, "response": json.dumps(text)}) + "\n")
        ingest.start(ingest.read_landed(spark, f"{root}/landed", 1), dataset, f"{root}/state", "feed", lambda: NOW, unused=f"{root}/unused").awaitTermination()
        assert (dataset.refresh().manifest is not None) == (part == 1)
    assert dataset.scan().count() == 1


def test_parts_over_batches_and_a_late_older_answer(spark, root):
    import os

    os.makedirs(f"{root}/landed")
    dataset = Dataset(spark, f"{root}/data", INDEX_DAILY)

    def go(name, *parts):
        with open(f"{root}/landed/{name}", "w") as f:
            for arrival, part, of, days, close in parts:
                items = [["A", f"2026{x}", close, *["1"] * 8] for x in days]
                body = {"code": 0, "data": {"fields": INDEX_DAILY.columns, "items": items}}
                f.write(json.dumps({"request_id": f"r{arrival}", "key": "A", "start": "2026-07-13", "end": "2026-07-16",
                                    "arrival": arrival, "part": part, "parts": of, "response": json.dumps(body)}) + "\n")
        ingest.start(ingest.read_landed(spark, f"{root}/landed", 1), dataset, f"{root}/state", "feed", lambda: NOW, unused=f"{root}/unused").awaitTermination()

    go("1.json", (9, 0, 1, ["0713", "0714", "0715"], "1"))
    go("2.json", (10, 0, 2, ["0713"], "2"))
    assert dataset.refresh().manifest.revision == 1 and dataset.scan().count() == 3
    go("3.json", (10, 1, 2, ["0714"], "2"), (8, 0, 1, ["0715"], "0"))
    assert rows(dataset.refresh().scan(), "trade_date", "close") == [(d("07-13"), 2.0), (d("07-14"), 2.0)]
    go("4.json", (9, 0, 1, ["0713"], "1"))
    assert dataset.refresh().manifest.revision == 2
    left = spark.read.parquet(f"{root}/unused")
    assert rows(left, "status", "arrival") == [("late", 8), ("late", 9)]


def memory_stream(spark, root, df, name):
    """One file per row group of ``df``, read back as a stream."""
    path = f"{root}/{name}"
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_running_coverage(spark, root):
    items = [("A", "07-01"), ("A", "07-02"), ("A", "07-04"), ("B", "07-01"), ("B", "07-02")]
    df = spark.createDataFrame([(k, d(x)) for k, x in items], "k string, day date").repartition(3, "day")
    stream = memory_stream(spark, root, df, "facts")
    coverage.follow(stream, "k", "day", f"{root}/out", f"{root}/state").awaitTermination()
    assert rows(coverage.read(spark, f"{root}/out")) == [
        ("A", d("07-01"), d("07-05"), 3, True),
        ("B", d("07-01"), d("07-03"), 2, False),
    ]


def test_acknowledgements_arrive_later(spark, root):
    t0 = datetime(2026, 7, 20, 0, 0)
    stamps = lambda *x: [(i, t0 + timedelta(minutes=m)) for i, m in x]
    left = spark.createDataFrame(stamps(("e1", 0), ("e2", 1), ("late", 6000)), "event_id string, ts timestamp")
    right = spark.createDataFrame(stamps(("e1", 30), ("none", 6000)), "reference string, acked_at timestamp")
    joined = events.with_acknowledgements(
        memory_stream(spark, root, left.repartition(1).sortWithinPartitions("ts"), "events"),
        memory_stream(spark, root, right.repartition(1).sortWithinPartitions("acked_at"), "acks"),
        "1 day",
        "10 minutes",
    )
    sinks.write_batches(joined, f"{root}/out", f"{root}/state", "append").awaitTermination()
    # read the records back without the batch folder
    got = spark.read.parquet(f"{root}/out").select("event_id", "acknowledged")
    assert rows(got) == [("e1", True), ("e2", False)]


def test_unread_state(spark, root):
    log = spark.createDataFrame(
        [("e1", "task", "error", None), ("e2", "task", "info", None), ("k", "acknowledgement", "info", "e1")],
        "event_id string, kind string, severity string, reference string",
    )
    events.follow(memory_stream(spark, root, log.repartition(3), "log"), f"{root}/out", f"{root}/state").awaitTermination()
    assert rows(events.unread(spark, f"{root}/out")) == [("e2", "info")]


def test_upserts_touch_only_their_buckets(spark, root):
    at = f"{root}/table"
    frame = lambda *items: spark.createDataFrame(items, "k int, v string")
    schema = frame((1, "a")).schema
    files = lambda: {f.split("/")[-2]: f for f in sinks.current(spark, at, schema).inputFiles()}
    assert sinks.current(spark, at, schema).isEmpty()
    sinks.upsert(frame(*[(i, "old") for i in range(40)], (None, "old")), 0, at, ["k"], buckets=8)
    before = files()
    assert len(before) == 8
    sinks.upsert(frame((3, "new"), (None, "new")), 1, at, ["k"], buckets=8)
    sinks.upsert(frame((3, "new"), (None, "new")), 1, at, ["k"], buckets=8)  # again, as after a failure
    after = files()
    assert len(after) == 8 and 0 < sum(after[b] != before[b] for b in after) <= 2
    want = {(i, "new" if i in (3, None) else "old") for i in [*range(40), None]}
    assert {tuple(r) for r in sinks.current(spark, at, schema).collect()} == want
    for n in range(2, 5):
        sinks.upsert(frame((3, f"v{n}")), n, at, ["k"], buckets=8)
    assert len(files()) == 8 and ("v4",) in rows(sinks.current(spark, at, schema).where("k = 3"), "v")


def test_activity_and_bursts(spark, root):
    t0 = datetime(2026, 7, 20, 23, 50)
    items = [("u", t0 + timedelta(minutes=m)) for m in (0, 5, 20, 70, 200)]
    df = spark.createDataFrame(items, "who string, ts timestamp_ntz")
    counts = activity.per_bucket(memory_stream(spark, root, df.coalesce(1), "ts"), "ts", "1 hour", delay="1 hour")
    sinks.write_batches(counts, f"{root}/out", f"{root}/state").awaitTermination()
    got = sinks.latest(spark, f"{root}/out", ["bucket_start"], counts.schema)
    assert sorted(r["events"] for r in got.collect()) == [1, 1, 1, 2]
    live = activity.bursts(memory_stream(spark, root, df.coalesce(1), "b"), "ts", "who", "30 minutes", delay="1 hour")
    sinks.write_batches(live, f"{root}/bursts", f"{root}/state2", "append").awaitTermination()
    done = activity.finished_bursts(df, "ts", "who", ["ts"], 30 * 60)
    assert sorted(r["events"] for r in done.collect()) == [1, 1, 3]
    early = spark.read.parquet(f"{root}/bursts")
    assert rows(early, "events") == [(1,), (3,)]


def test_bursts_from_cells_equal_finished_ones(spark, root):
    import random

    r = random.Random(6)
    t0 = datetime(2026, 7, 20, 22)
    items = [(r.choice(["hot", "hot", "a", None]), t0 + timedelta(seconds=r.randrange(0, 300_000))) for _ in range(400)]
    items += [("edge", t0 + timedelta(minutes=30 * i)) for i in range(5)]  # pauses of just the gap
    df = spark.createDataFrame(items, "who string, ts timestamp_ntz")
    stream = memory_stream(spark, root, df.repartition(3, "ts"), "events")
    activity.follow_bursts(stream, "ts", "who", 1800, f"{root}/out", f"{root}/state").awaitTermination()
    got = activity.read_bursts(spark, f"{root}/out", activity.cells(df, "ts", "who", 1800).schema, "who", 1800)
    want = activity.finished_bursts(df, "ts", "who", ["ts"], 1800)
    assert rows(got) == rows(want) and ("edge", 5) in rows(got, "who", "events")


def test_late_arrivals(spark):
    utc = lambda h: datetime(2026, 7, 20, h, 30)
    df = spark.createDataFrame(
        [(d("07-20"), utc(6)), (d("07-20"), utc(7)), (d("07-20"), utc(9)), (d("07-20"), utc(16)), (d("07-22"), utc(9))],
        "day date, got timestamp_ntz",
    )
    out = activity.arrival_class(df, "day", "got").select("arrival")
    assert [r[0] for r in out.collect()] == [
        "before-window", "inside-window", "after-window", "after-window", "before-window"]
