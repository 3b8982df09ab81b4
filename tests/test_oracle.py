"""Every query with an oracle must equal its DuckDB SQL (smallest scale)."""

import duckdb
import pytest

import __spark_entry__ as entry_mod
from tessera.plans.catalog import all_queries
from tessera.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

_WITH_ORACLE = sorted(n for n, q in all_queries().items() if q.oracle)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", _WITH_ORACLE)
def test_query_matches_oracle(spark, con, name):
    msg = compare(spark, con, name, all_queries()[name], SF_SMALL)
    assert " OK " in msg, msg


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert set(_WITH_ORACLE) <= set(entry_mod.oracle_sql())
