"""Every registered query against its DuckDB oracle on the smoke tables."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMOKE
from tidemark.plans.catalog import QUERIES
from tools.oracle_check import TABLES, digest

ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}     # the library's own


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMOKE)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns)[0] == digest(orows, ocols)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "forward_return" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
