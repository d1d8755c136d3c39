"""Every query of the catalog against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from arraylume.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in catalog.ORACLE:
        return
    want = duck.sql(catalog.ORACLE[name]).df()
    got, want = canonical(got), canonical(want)
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c
