"""Every registered query equals its DuckDB oracle on the small synthetic tables."""

import duckdb
import pytest

from check import compare, register_views
from conftest import SF_SMALL

import __spark_entry__ as E

from pathweave.oracle.registry import all_sql
from pathweave.plans.registry import all_queries

QUERIES = all_queries()
SQL = all_sql()


#: Queries whose condition no row of the smallest tables meets.
EMPTY_ON_SMALL = {"lateral_unnest", "stall_item_ranking"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    register_views(c, SF_SMALL)
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    odd = [(f.name, f.dataType.simpleString()) for f in df.schema.fields
           if f.dataType.simpleString() not in ("bigint", "double", "string", "boolean")]
    assert not odd, f"{name}: non-canonical Spark types {odd}"
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert orows or name in EMPTY_ON_SMALL, f"{name}: nothing to compare"
    otypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({SQL[name]})").fetchall()}
    assert set(otypes.values()) <= {"BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN"}, f"{name}: {otypes}"
    problem = compare(df.columns, srows, ocols, orows)
    assert problem is None, f"{name}: {problem}"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "level_id" in df.columns
