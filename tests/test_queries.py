"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import pytest

from tracelens import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is None, v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert got
        return
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = [tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall()]
    assert in_order(got) == in_order(want)
