"""Every registered query of the engine against its SQL, at the smallest scale."""

import duckdb
import pytest
from oracle import compare, connect

from quillstore import queries


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, sf, name):
    assert compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], sf) is None


def against_sql_of_copy(spark, sf, to, name, table, columns):
    """What differs on a copy of a table with other values in ``columns``."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ({columns}) FROM '{sf}/{table}.parquet') TO '{to}/{table}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{to}/{table}.parquet'")
    return compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], str(to))


@pytest.mark.parametrize("step", [1, 997, 10**9])
def test_addresses_of_larger_keys(spark, sf, tmp_path, step):
    assert against_sql_of_copy(spark, sf, tmp_path, "addresses", "part", f"p_partkey * {step} AS p_partkey") is None


@pytest.mark.parametrize("columns", ["user_id * 2011 AS user_id", "ts + to_days(CAST(event_id % 3000 AS INTEGER)) AS ts", "user_id * 1000000007 AS user_id"])
def test_time_texts_beyond_the_range_of_a_time(spark, sf, tmp_path, columns):
    assert against_sql_of_copy(spark, sf, tmp_path, "time_texts", "events", columns) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = queries.key_range_slice(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "EqualTo(o_orderstatus,O)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    assert "TakeOrderedAndProject" in plan
