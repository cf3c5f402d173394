import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

PLAIN = [n for n in entry.queries() if not re.match(r"op\d+_", n) and n != "pipeline"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_its_sql(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, float(x) if isinstance(x, (int, float)) else str(x)) for x in r)
    assert sorted(map(key, rows)) == sorted(key(tuple(r[i] for i in order)) for r in want.fetchall())
