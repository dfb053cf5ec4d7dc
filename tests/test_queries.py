"""Every registered query against its SQL on the small tables; the driver does the same on larger ones."""

import os

import pytest

import __spark_entry__ as entry
from sparkloom.plans.catalogue import ORACLE_SQL, QUERIES
from tools.compare import plain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLE_SQL[name])
    names, want = [c[0] for c in cursor.description], cursor.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = df.collect()
    rows = lambda data, at: sorted(tuple(str(plain(r[at(c)])) for c in columns) for r in data)
    assert rows(got, df.columns.index) == rows(want, names.index)
