"""Every query with SQL against DuckDB over the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import registry
from lodestone.session import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return str([_plain(x) for x in value])
    return str(value)


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return found


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    assert rows == sorted(tuple(map(_plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert set(registry.queries()) <= set(names)
    if os.path.isdir(SF_DIR):
        assert __spark_entry__.entry(spark).count() == 10


def test_short_windows_of_a_stream_are_counts(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("the tables aren't here")
    counts = registry.queries()["tumbling_windows"](spark, SF_DIR)
    whole = registry.queries()["time_series"](spark, SF_DIR)
    assert counts.selectExpr("cast(start as timestamp_ntz) as hour", "event_type", "n").exceptAll(whole).isEmpty() and counts.count() > 0
