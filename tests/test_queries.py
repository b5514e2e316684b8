"""Every query that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr(tuple(clean(v) for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert plain(got.select(cols).collect()) == plain([[r[i] for i in at] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
