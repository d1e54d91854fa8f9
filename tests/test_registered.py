"""Every registered query against its expected SQL on the smallest data set."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402
from forgeledger.plans import catalog  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, EXPECTED = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    verdict = compare(spark, db, FOLDER, name, QUERIES[name], EXPECTED.get(name))
    if verdict == "EMPTY":  # the smallest data have no such rows
        verdict = compare(spark, connect(LARGER), LARGER, name, QUERIES[name], EXPECTED.get(name))
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert E.entry(spark).count() == 150


def test_every_query_has_an_expected_result():
    assert set(EXPECTED) == set(QUERIES)


def test_no_cross_joins_in_plans(spark):
    for name in ("org_routing", "map_custom", "migration_plan", "new_commits", "retention_combined", "transitive_closure"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), name
