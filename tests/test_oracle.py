"""Every registered query against its DuckDB oracle (sf0.001), and the driver entry point."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows, type_mismatches

from quire.plans import registry

from conftest import SF001

KEYS = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.oracle_sql()) and set(KEYS) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    spark_df = E.queries()[key](spark, SF001)
    rel = con.sql(E.oracle_sql()[key])
    assert type_mismatches(spark_df, rel) == {}
    got = spark_df.toPandas()
    want = rel.df()
    gc, gr = rows(got)
    wc, wr = rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["file_id", "tenant_id"]
    assert df.count() > 0
