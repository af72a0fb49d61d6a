import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import d, rows
from covspark.errors import (
    ContractError,
    CoverageError,
    DatasetNotFoundError,
    DatasetNotReadyError,
    PublishConflictError,
    UnsupportedCoverageError,
)
from covspark.operators import status
from covspark.operators.mutate import Mutation
from covspark.sources import export
from covspark.sources.revisions import Dataset, open_dataset
from covspark.spec import COVERAGE_SCHEMA, DEMO_HELLO, SPECS, DatasetSpec, fields

SPEC = DatasetSpec(
    "test/daily",
    fields("ts_code string!, trade_date date!, close double"),
    primary_key=("ts_code", "trade_date"),
    partition_key="ts_code",
    time_field="trade_date",
)


def daily(spark, *items):
    return spark.createDataFrame([(k, d(x), float(v)) for k, x, v in items], SPEC.schema)


def cover(spark, *items):
    return spark.createDataFrame([(k, d(a), d(b)) for k, a, b in items], COVERAGE_SCHEMA)


@pytest.fixture
def published(spark, root):
    dataset = Dataset(spark, root, SPEC)
    dataset.publish(
        [Mutation.complete(daily(spark, ("A", "06-30", 1), ("A", "07-01", 2), ("B", "07-02", 3)))],
        cover(spark, ("A", "06-30", "07-02"), ("B", "07-02", "07-03")),
    )
    return dataset


def test_states(spark, root):
    with pytest.raises(DatasetNotFoundError):
        open_dataset(spark, root, "market/nothing", SPECS)
    with pytest.raises(ValueError):
        open_dataset(spark, root, "nothing", SPECS)
    dataset = open_dataset(spark, root, "market/trade_cal", SPECS)
    assert status.summary(dataset)["state"] == "uninitialized"
    assert os.listdir(root) == []
    with pytest.raises(DatasetNotReadyError):
        dataset.scan()
    empty = spark.createDataFrame([], dataset.spec.schema)
    dataset.publish([Mutation.complete(empty)], cover(spark))
    found = status.summary(dataset)
    assert (found["state"], found["covered_keys"], found["revision"]) == ("ready", 0, 1)
    assert dataset.scan().isEmpty()


def test_publish_and_query(spark, root, published):
    got = published.query(keys=["A"], time_range=("2026-06-30", "2026-07-02"), require_coverage=True)
    assert rows(got, "close") == [(1.0,), (2.0,)]
    with pytest.raises(CoverageError):
        published.query(keys=["A"], time_range=("2026-06-30", "2026-07-03"), require_coverage=True)
    assert rows(published.preview(limit=2), "close") == [(1.0,), (2.0,)]
    assert rows(published.sql("select max(close) as top from data")) == [(3.0,)]
    assert rows(published.coverage(["B"])) == [("B", d("07-02"), d("07-03"))]
    found = status.summary(published)
    assert (found["covered_keys"], found["covered_start"], found["covered_end"]) == (2, d("06-30"), d("07-03"))
    assert found["storage_bytes"] > 0


def test_only_touched_months_are_written(spark, root, published):
    before = dict(published.manifest.parts)
    published.publish(
        [Mutation.range(daily(spark, ("B", "07-02", 9)), "B", d("07-02"), d("07-03"))],
        cover(spark, ("A", "06-30", "07-02"), ("B", "07-02", "07-03")),
    )
    after = published.manifest.parts
    assert after["2026-06"] == before["2026-06"] and after["2026-07"] != before["2026-07"]
    assert rows(published.scan(), "close") == [(1.0,), (2.0,), (9.0,)]


def test_a_deleted_month_disappears(spark, published):
    published.publish(
        [Mutation.range(daily(spark), "A", d("06-01"), d("07-01"))], cover(spark, ("B", "07-02", "07-03"))
    )
    assert list(published.manifest.parts) == ["2026-07"]
    assert rows(published.scan(), "close") == [(2.0,), (3.0,)]


def test_readers_keep_their_revision(spark, root, published):
    reader = Dataset(spark, root, SPEC)
    old = reader.scan()
    published.publish([Mutation.complete(daily(spark, ("C", "07-05", 7)))], cover(spark))
    assert old.count() == 3 and reader.scan().count() == 3
    assert reader.refresh().scan().count() == 1
    assert reader.coverage().isEmpty()


def test_lost_race_is_refused(spark, root, published):
    late = Dataset(spark, root, SPEC)
    published.publish([Mutation.primary_keys(daily(spark, ("A", "07-01", 5)))], cover(spark))
    with pytest.raises(PublishConflictError):
        late.publish([Mutation.primary_keys(daily(spark, ("A", "07-01", 6)))], cover(spark))
    assert (5.0,) in rows(late.refresh().scan(), "close")
    names = os.listdir(f"{late.path}/manifests")
    assert sorted(n for n in names if not n.startswith(".")) == ["1.json", "2.json"]


@pytest.mark.parametrize("problem", ["duplicate", "null", "no date", "scope", "coverage", "schema", "no coverage"])
def test_a_failed_commit_changes_nothing(spark, root, published, problem):
    rows_ = daily(spark, ("A", "07-01", 5))
    held = cover(spark, ("A", "06-30", "07-02"))
    if problem == "duplicate":
        mutation = Mutation.primary_keys(daily(spark, ("A", "07-01", 5), ("A", "07-01", 6)))
    elif problem in ("null", "no date"):
        row = (None, d("07-01"), 1.0) if problem == "null" else ("A", None, 1.0)
        loose = spark.createDataFrame([row], "ts_code string, trade_date date, close double")
        mutation = Mutation.primary_keys(loose)
    elif problem == "scope":
        mutation = Mutation.range(rows_, "A", d("07-02"), d("07-03"))
    elif problem == "schema":
        mutation = Mutation.complete(rows_.select("trade_date", "ts_code", "close"))
    else:
        mutation = Mutation.primary_keys(rows_)
    if problem == "coverage":
        held = held.union(held)
    if problem == "no coverage":
        held = None
    with pytest.raises(ContractError):
        published.publish([mutation], held)
    fresh = Dataset(spark, root, SPEC)
    assert fresh.manifest.revision == 1
    assert len([n for n in os.listdir(fresh.path) if n.startswith("rev=")]) == 1
    assert rows(fresh.scan(), "close") == [(1.0,), (2.0,), (3.0,)]
    assert fresh.coverage().count() == 2


def test_several_mutations_in_one_commit(spark, published):
    published.publish(
        [
            Mutation.range(daily(spark, ("A", "06-30", 10)), "A", d("06-01"), d("08-01")),
            Mutation.primary_keys(daily(spark, ("A", "06-30", 11), ("B", "07-02", 12))),
        ],
        cover(spark, ("A", "06-30", "07-02")),
    )
    assert rows(published.scan(), "ts_code", "close") == [("A", 11.0), ("B", 12.0)]


def test_history(spark, published):
    published.publish([Mutation.primary_keys(daily(spark, ("B", "07-03", 5)))], cover(spark))
    got = rows(published.history(), "revision", "mutations", "rows_written")
    assert got == [(1, 1, 3), (2, 1, 3)]
    assert published.history().where(F.col("publication_id") == published.manifest.publication_id).count() == 1


def test_repeated_batch_is_a_no_op(spark, published):
    args = ([Mutation.primary_keys(daily(spark, ("A", "07-01", 5)))], cover(spark))
    first = published.publish(*args, batch=("s", 0))
    assert published.publish(*args, batch=("s", 0)) == first
    assert published.manifest.revision == 2


def test_no_time_field(spark, root):
    dataset = Dataset(spark, root, DEMO_HELLO)
    people = lambda *x: spark.createDataFrame([(n, g, 1) for n, g in x], DEMO_HELLO.schema)
    dataset.publish([Mutation.complete(people(("a", "old"), ("b", "keep")))])
    dataset.publish([Mutation.primary_keys(people(("a", "new")))], cover(spark))
    assert rows(dataset.scan(), "greeting") == [("keep",), ("new",)]
    with pytest.raises(ContractError):
        dataset.publish([Mutation.complete(people())], cover(spark, ("a", "07-01", "07-02")))
    with pytest.raises(UnsupportedCoverageError):
        dataset.coverage()
    assert status.summary(dataset)["covered_keys"] is None


def test_time_field_outside_the_key(spark, root):
    spec = DatasetSpec("test/ids", fields("id long!, key string, day date"), ("id",), "key", None, "day")
    frame = lambda *x: spark.createDataFrame([(i, k, d(t)) for i, k, t in x], spec.schema)
    dataset = Dataset(spark, root, spec)
    dataset.publish([Mutation.complete(frame((1, "A", "06-30"), (2, "A", "07-01")))], cover(spark))
    # the same id moves to another month
    dataset.publish([Mutation.primary_keys(frame((1, "B", "07-02")))], cover(spark))
    got = dataset.query(time_range=("2026-07-01", "2026-08-01"), order_by=["id"])
    assert rows(got, "id", "key") == [(1, "B"), (2, "A")]
    with pytest.raises(ContractError):
        dataset.publish([Mutation.range(frame((2, "C", "07-03")), "C", d("07-01"), d("07-09"))], cover(spark))


def test_other_contract_is_refused(spark, root, published):
    other = DatasetSpec(SPEC.name, SPEC.schema, ("ts_code",), "ts_code", None, "trade_date")
    with pytest.raises(ContractError):
        Dataset(spark, root, other)


def test_snapshot(spark, root, published):
    there = published.export_snapshot(f"{root}/copy")
    assert rows(spark.read.parquet(f"{there}/data"), "close") == [(1.0,), (2.0,), (3.0,)]
    assert spark.read.parquet(f"{there}/coverage").count() == 2
    with open(f"{there}/manifest.json") as f:
        assert json.load(f)["publication_id"] == published.manifest.publication_id
    with pytest.raises(FileExistsError):
        published.export_snapshot(f"{root}/copy")
    with pytest.raises(ValueError):
        published.export_snapshot(published.path)


@pytest.mark.parametrize("kind", export.FORMATS)
def test_exports(spark, root, published, kind):
    held = published.coverage()
    published.publish(
        [Mutation.primary_keys(daily(spark, ("A", "07-03", 4)).withColumn("close", F.lit(None).cast("double")))],
        held,
    )
    path = f"{root}/out.{kind}"
    done = export.query_result(published, path, kind)
    assert done.rows == 4 and done.publication_id == published.manifest.publication_id
    read = {
        "csv": lambda: spark.read.schema(SPEC.schema).option("header", True).csv(path),
        "parquet": lambda: spark.read.parquet(path),
        "jsonl": lambda: spark.read.schema(SPEC.schema).json(path),
        "arrow": lambda: export.read_arrow(spark, path, SPEC.schema),
    }[kind]
    assert rows(read(), "ts_code", "trade_date", "close") == rows(published.scan())
    with pytest.raises(FileExistsError):
        export.write(published.scan(), path, kind)
    again = export.write(published.scan().where("ts_code = 'A'"), path, kind, force=True)
    assert again.rows == 3 and read().count() == 3
    if kind == "jsonl":
        lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
        assert {"ts_code": "A", "trade_date": "2026-07-03", "close": None} in lines


def test_export_needs_a_parent_and_a_known_format(spark, root, published):
    with pytest.raises(FileNotFoundError):
        export.write(published.scan(), f"{root}/no/where", "csv")
    with pytest.raises(ValueError):
        export.write(published.scan(), f"{root}/x", "xml")


def test_batches_are_bounded(spark, published):
    done = export.for_each_batch(published.scan().coalesce(1), lambda b: b.num_rows, batch_size=2)
    total = done.agg(F.sum("batches"), F.sum("rows"), F.sum("result")).first()
    assert tuple(total) == (2, 3, 3)
    with pytest.raises(ValueError):
        export.for_each_batch(published.scan(), len, batch_size=0)
