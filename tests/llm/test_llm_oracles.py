"""Every operator query with SQL against DuckDB over whole small tables."""

import math
import os

import duckdb
import pytest

from hubflow.llm import queries as Q

SF = "/root/testdata/sf0.001"


def _norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) + 0.0 if isinstance(v, float) else v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    got = _rows(Q.QUERIES[name](spark, SF).toPandas())
    assert got == _rows(con.execute(Q.ORACLE_SQL[name]).df())
    assert got[1]


def test_queries_of_all_operators_are_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
