from __future__ import annotations

import os

import __spark_entry__ as entry
import oracle_check
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF)


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    numbers = {n.split("_")[0] for n in queries if n.startswith("op") and n[2].isdigit()}
    assert numbers in (set(), {f"op{i}" for i in range(1, 14)})
    assert ("pipeline" in queries) == bool(numbers)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    assert oracle_check.compare(df, duck, entry.oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["complaints"] >= rows[-1]["complaints"]
