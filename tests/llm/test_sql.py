"""The queries with SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

queries = pytest.importorskip("tracklake.llm.queries")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_license_scan", "op3_minhash", "op6_suffix_dedup", "op7_quality_rules", "op8_decontaminate", "op10_sharding", "op11_chat_format", "op12_fill_in_middle", "op13_hard_negatives"])
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got and got == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
