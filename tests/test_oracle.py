"""Every query with SQL against DuckDB over the same tables."""

import os

import duckdb
import pytest

from sampleflow import plans

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("documents", "events", "orders", "conversations", "customer", "supplier")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, con, name):
    df = plans.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    cursor = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert got == want


def test_padding_keeps_every_token(spark, con):
    rows = plans.queries()["pad_whole"](spark, SF_DIR).orderBy("pos").collect()
    got = [int(x) for r in rows for x in r["input_ids"].split(",")]
    assert len(got) == 32 * len(rows)
    texts = con.execute("select text from conversations order by conv_id, turn").fetchall()
    assert [x for x in got if x != plans.PAD] == [len(w) for (t,) in texts for w in t.split()]
