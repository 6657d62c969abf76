"""Every registered operator query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import decimal
import os

import pytest

from relayloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.SQL:
        assert rows
        return
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = ordered(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall())
    assert rows == want
