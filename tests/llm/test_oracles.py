"""Registered queries of the subpackage that SQL can express, against DuckDB."""

from collections import Counter

import duckdb
import pytest

from lodestone.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
