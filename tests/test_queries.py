"""Every registered query against DuckDB on the smallest tables, and the shape of some plans."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sparkloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(frame):
    def one(v):
        if pd.isna(v):
            return "NULL"
        return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool" else repr(round(float(v), 6))

    cols = sorted(frame.columns)
    return cols, sorted(tuple(one(v) for v in row) for row in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_duckdb(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["repo_attribution", "guard_verdict", "conflict_inflight", "delivery_kinds", "meter_by_repo"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_what_they_use(spark):
    plan = QUERIES["content_hashes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
