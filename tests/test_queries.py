"""Every registered query with SQL equals it on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from lamina.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([c[0] for c in found.description], found.fetchall())
