"""Every registered detection query against its SQL in DuckDB, and plan checks."""

import datetime
import decimal

import duckdb
import pytest

from chorusframe import queries, queries_files, queries_jobs  # noqa: F401
from chorusframe.views import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


def rows(cols, data):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(plain(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(list(rel.columns), rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_others_give_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_band_joins_are_equi_joins(spark):
    for name in ("j1_match_review", "j3_match_nearest", "j4_m3_recall", "j5_no_overlap", "j6_guard_distance"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
