"""Every query of the catalogue gives the rows of its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from helixframe import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, DIR).toPandas()
    if name not in plans.ORACLE:
        assert len(got.columns)
        return
    want = sql.execute(plans.ORACLE[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a = got[cols].sort_values(cols).reset_index(drop=True)
    b = want[cols].sort_values(cols).reset_index(drop=True)
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)
