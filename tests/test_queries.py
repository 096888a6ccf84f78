"""Every query of the catalogue at the smallest scale, against its SQL where it has one."""

import os

import duckdb
import pytest

from terraweave.plans import catalog


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, tables, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLE:
        assert len(got.columns)
        return
    want = tables.execute(catalog.ORACLE[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns) and len(got) == len(want)
    a, b = (x[order].astype(object).where(x[order].notna(), None).astype(str).sort_values(order).reset_index(drop=True) for x in (got, want))
    assert a.equals(b), a.compare(b).head()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
