"""Every query with an SQL twin gives the same rows as the twin at the smallest scale."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from corduroy.plans.registry import all_queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in all_queries().items() if sql])
def test_twin(spark, duck, name):
    run, sql = all_queries()[name]
    df = run(spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want
