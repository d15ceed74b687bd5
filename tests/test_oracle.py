"""Every query of the registry against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from nearwise.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert dict(got[columns].dtypes.astype(str)) == dict(want[columns].dtypes.astype(str))
    tidy = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))
