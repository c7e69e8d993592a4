"""The registered queries with SQL, side by side with DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from triloom.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, DATA)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    want = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in want.description]
    rows = sorted(tuple(dict(zip(order, r, strict=True))[c] for c in sorted(order)) for r in want.fetchall())
    assert sorted(order) == sorted(df.columns) and got == rows
