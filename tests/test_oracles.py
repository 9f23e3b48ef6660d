"""Every registered query against its DuckDB oracle on the smallest scale
factor (the driver repeats this at sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from sitelens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6)) if not math.isnan(v) else "NaN"
    return str(v)


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(_norm(r[i]) for i in order) for r in recs)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = E.oracle_sql().get(name)
    assert sql is not None, f"{name} has no oracle"
    rel = con.sql(sql)
    o_cols, o_rows = _rows(rel.columns, rel.fetchall())
    assert s_cols == o_cols
    assert s_rows == o_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["block_name", "variant_name", "layout_name", "language", "occurrence",
                          "last_modified", "page_url"]
