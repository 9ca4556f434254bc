"""Every query runs, and equals its SQL where it has any."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.7g}"
    if isinstance(v, int):
        return f"{float(v):.7g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.execute(f"create view {t.split('.')[0]} as select * from '{data}/{t}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, data, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
