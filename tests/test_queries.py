"""Every query against the SQL that an independent engine runs on the same files."""

import os

import duckdb
import pandas as pd
import pytest

from lectern.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data is not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(df):
    def text(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, bytes)) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = canonical(QUERIES[name](spark, SF).toPandas()), canonical(duck.sql(ORACLE[name]).df())
    assert got[0] == want[0]
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) < 1e-6
    assert len(got[1]) == len(want[1])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns and out.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
