"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from vernalex import queries as core

DATA = os.environ.get("VERNALEX_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = norm(tuple(r[c] for c in cols) for r in df.collect())
    sql = core.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert norm(tuple(g[names.index(c)] for c in cols) for g in r.fetchall()) == rows
