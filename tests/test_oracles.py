"""Every query with SQL gives DuckDB's rows; the others give rows."""

import duckdb
import numpy as np
import pytest

from pulseloom.plans import catalog
from pulseloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"group_comparison", "filter_bank", "cluster_elbow"}


@pytest.fixture
def duck():
    """A connection for each case, so that a fatal error of one isn't reported by all that follow; two threads, since Spark has the others."""
    with duckdb.connect(config={"threads": 2, "memory_limit": "4GB"}) as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        yield con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].map(lambda x: "" if x is None or x is np.nan else str(x))
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-6, atol=2e-6)
        else:
            assert (a[c] == b[c]).all()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE) - SLOW))
def test_rows(spark, name):
    assert not catalog.QUERIES[name](spark, SF).isEmpty()
