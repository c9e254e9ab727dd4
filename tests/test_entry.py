import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from dagbag.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, (float, np.floating)) else v
    return sorted(map(repr, (tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, db, name):
    got = entry.queries()[name](spark, SF)
    if name not in ORACLE_SQL:
        assert got.count() > 0
        return
    want = db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
