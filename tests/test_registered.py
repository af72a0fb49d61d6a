"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import compare  # noqa: E402
from __spark_entry__ import entry  # noqa: E402
from oracle_queries import QUERIES, SQL as ORACLE  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = compare.compare(spark, SF, name, QUERIES[name], ORACLE.get(name))
    assert found.startswith("ok"), found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, name):
    if name.startswith(("stream_", "published_", "export_")):
        pytest.skip("the plan only reads back what was written")
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["event_id", "user_id", "day", "value"]
    assert not entry(spark).isEmpty()
