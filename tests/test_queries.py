"""Every registered query against its SQL oracle (DuckDB) on the smallest tables,
plus the rows-only queries run to completion."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from spendlens.plans.queries import ORACLE, QUERIES

TABLES = ("customer orders lineitem events").split()
Q, SQL = QUERIES, ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{round(v, 6) + 0.0:.6f}"
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False))


def test_every_query_has_a_docstring():
    for name, fn in Q.items():
        assert fn.__doc__, name


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    got = _rows(Q[name](spark, SF_SMALL).toPandas())
    want = _rows(con.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_rows_only(spark, name):
    assert Q[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["position", "age_group", "mean", "count", "std"] and df.count() == 4
