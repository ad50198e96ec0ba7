import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from confluo.plans import catalog


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, engine, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = engine.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())


def test_entry_and_registry(spark):
    assert {r.decision: r.n for r in entry.entry(spark).collect()} == {"ours": 825, "drop": 225, "delete_edit": 150, "theirs": 150, "add_add": 75, "edit_edit": 75}
    assert set(entry.oracle_sql()) <= set(entry.queries())
