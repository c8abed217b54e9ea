"""Every query of the catalogue against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sparkloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"create view {name.partition('.')[0]} as select * from '{SF}/{name}'")
    return con


def _cells(rows, order):
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr([number(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert _cells([r.asDict() for r in got.collect()], order) == _cells(rows, order)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
