from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from covspark.errors import ContractError
from covspark.operators import mutate, validate
from covspark.operators.mutate import Mutation
from covspark.spec import COVERAGE_SCHEMA, DatasetSpec, fields

SPEC = DatasetSpec(
    "test/facts",
    fields("key string, day date, value long"),
    primary_key=("key", "day"),
    partition_key="key",
    time_field="day",
)
DAY0 = date(2026, 1, 25)  # ranges cross a month end


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def frame(spark, items):
    return spark.createDataFrame([(k, day(n), v) for k, n, v in items], SPEC.schema)


def plain(df):
    back = lambda x: None if x is None else (x - DAY0).days
    return sorted(((r[0], back(r[1]), r[2]) for r in df.collect()), key=str)


def sequential(base, steps):
    """The mutations one after another over Python lists."""
    for kind, items, scope in steps:
        if kind == "complete":
            base = []
        elif kind == "range":
            k, a, b = scope
            base = [r for r in base if not (r[0] == k and r[1] is not None and a <= r[1] < b)]
        else:
            hit = {(r[0], r[1]) for r in items if r[0] is not None and r[1] is not None}
            base = [r for r in base if (r[0], r[1]) not in hit]
        base = base + items
    return sorted(base, key=str)


key = st.sampled_from(["A", "B"])
cell = st.tuples(key, st.integers(0, 12))


def keyed(cells, value):
    return [(k, n, value) for k, n in sorted(set(cells))]


@st.composite
def step(draw, number):
    kind = draw(st.sampled_from(["range", "range", "primary_keys", "complete"]))
    if kind == "range":
        k, a, n = draw(key), draw(st.integers(0, 10)), draw(st.integers(1, 6))
        days = draw(st.sets(st.integers(a, a + n - 1), max_size=4))
        return kind, [(k, x, number) for x in sorted(days)], (k, a, a + n)
    return kind, keyed(draw(st.lists(cell, max_size=5)), number), None


@st.composite
def steps(draw):
    return [draw(step(i)) for i in range(draw(st.integers(1, 5)))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(cell, max_size=10), steps())
def test_one_pass_equals_sequential(spark, cells, plan):
    base = keyed(cells, -1) + [(None, 3, -2), ("A", None, -3)]
    mutations = []
    for kind, items, scope in plan:
        df = frame(spark, items)
        if kind == "range":
            mutations.append(Mutation.range(df, scope[0], day(scope[1]), day(scope[2])))
        else:
            mutations.append(Mutation(kind, df))
    got = mutate.apply(frame(spark, base), mutations, SPEC)
    assert plain(got) == sequential(base, plan)


def test_range_replacement(spark):
    base = frame(spark, [(k, n, 1) for k in "AB" for n in range(3)])
    new = frame(spark, [("A", 1, 2)])
    got = mutate.apply(base, [Mutation.range(new, "A", day(0), day(3))], SPEC)
    assert plain(got) == [("A", 1, 2), ("B", 0, 1), ("B", 1, 1), ("B", 2, 1)]


def test_pure_delete_and_null_keys_stay(spark):
    base = frame(spark, [("A", 0, 1), ("A", None, 2), (None, 0, 3)])
    got = mutate.apply(base, [Mutation.range(frame(spark, []), "A", day(0), day(9))], SPEC)
    assert plain(got) == sorted([("A", None, 2), (None, 0, 3)], key=str)


def test_scope_and_schema_checks(spark):
    inside = Mutation.range(frame(spark, [("A", 1, 1)]), "A", day(0), day(2))
    mutate.check(inside, SPEC)
    for bad in [("B", 1, 1), ("A", 2, 1), ("A", None, 1)]:
        with pytest.raises(ContractError):
            mutate.check(Mutation.range(frame(spark, [bad]), "A", day(0), day(2)), SPEC)
    with pytest.raises(ContractError):
        mutate.check(Mutation.complete(frame(spark, []).select("day", "key", "value")), SPEC)
    with pytest.raises(ContractError):
        Mutation.range(frame(spark, []), "", day(0), day(2))
    with pytest.raises(ContractError):
        Mutation.range(frame(spark, []), "A", day(2), day(2))


def test_many_scopes_at_once(spark):
    scopes = spark.createDataFrame(
        [("A", day(n), day(n + 1)) for n in range(0, 10, 2)], COVERAGE_SCHEMA
    )
    base = frame(spark, [("A", n, 1) for n in range(10)])
    got = mutate.replace_ranges(base, frame(spark, [("A", 0, 9)]), scopes, "key", "day")
    assert plain(got) == sorted([("A", 0, 9)] + [("A", n, 1) for n in range(1, 10, 2)], key=str)


def test_merge_last_wins(spark):
    schema = "id string, name string, at int"
    base = spark.createDataFrame([("a", "old"), ("b", "old")], "id string, name string")
    new = spark.createDataFrame([("b", "new", 1), ("b", "newer", 2), ("c", None, 1)], schema)
    got = mutate.merge_last_wins(base, new, ["id"], "at")
    assert rows(got) == [("a", "old"), ("b", "newer"), ("c", None)]
    with pytest.raises(Exception, match="conflicting rows for key b"):
        mutate.merge_last_wins(base, new, ["id"], "at", "error").collect()
    same = spark.createDataFrame([("b", "x", 1), ("b", "x", 2)], schema)
    assert rows(mutate.merge_last_wins(base, same, ["id"], "at", "error")) == [("a", "old"), ("b", "x")]


def test_key_checks(spark):
    df = frame(spark, [("A", 0, 1), ("A", 0, 2), (None, 1, 1), (None, 1, 2), ("B", 0, 1)])
    assert rows(validate.keys(df, ["key", "day"]), "problem", "rows") == [
        ("duplicate key", 2), ("null key", 2)]
    assert rows(validate.duplicates(df, ["key", "day"]), "key") == [("A",), (None,)]
    assert validate.null_keys(df, ["key", "day"]).first()["null_key_rows"] == 2
