"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexigrove.plans import catalogue
from tests.conftest import DATA


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    rows, cols = df.collect(), sorted(df.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    theirs = [x[0] for x in cur.description]
    assert sorted(theirs) == cols
    want = sorted(tuple(plain(r[theirs.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == want
