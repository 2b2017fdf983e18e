"""Every query of the subpackage that has SQL against DuckDB over the same tables."""

import os

import duckdb
import pytest

from sampleflow.llm import queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert got == want and len(got) > 50
