"""Every registered catalog query with an oracle gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from prismata.plans import registry

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


def rows(df):
    value = lambda v: None if not isinstance(v, (list, tuple)) and pd.isna(v) else v if isinstance(v, (bool, str)) else float(v)
    found = [tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)]
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count()
