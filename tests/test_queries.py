"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from tracklake.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple(v + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(tuple(r[k] for k in at) for r in want.fetchall())


def test_draws_without_sql(spark):
    got = QUERIES["different_task"](spark, SF).collect()
    t = {r.id: r.task for r in __import__("tracklake.plans.canonical", fromlist=["x"]).trajectories(spark, SF).collect()}
    assert len(got) == len(t) and all(r.task != t[r.ref_id] and t[r.pick_id] == r.task for r in got)
    again = QUERIES["different_task"](spark, SF).repartition(7).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    draws = QUERIES["balanced_draws"](spark, SF).collect()
    assert len(draws) == 1000
    share = sum(r.data_source == "BUILDING" for r in draws) / 1000
    assert 0.36 < share < 0.50  # 3 of 7
    types = QUERIES["sample_types"](spark, SF).collect()
    assert all(r.strategy for r in types)
    for r in QUERIES["human_robot_triples"](spark, SF).collect():
        assert r.task != r.negative_task


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
