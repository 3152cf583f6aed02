"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from lumenbase import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    rows = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(plans.queries()) <= set(__spark_entry__.queries())
