"""The queries that SQL expresses, and those it does not, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from nearwise.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert dict(got[columns].dtypes.astype(str)) == dict(want[columns].dtypes.astype(str))
    tidy = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))
