import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {n: s for n, s in entry.oracle_sql().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda it: sorted((repr(tuple(plain(x) for x in r)) for r in it))
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
