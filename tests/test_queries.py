"""Every query with SQL, side by side with DuckDB on the smallest tables; the package without the llm folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from triloom import queries

ROOT = Path(__file__).resolve().parent.parent
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        order = [c[0] for c in want.description]
        assert sorted(order) == sorted(df.columns)
        rows = [tuple(dict(zip(order, r, strict=True))[c] for c in sorted(order)) for r in want.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, rows))


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "triloom", tmp_path / "triloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and not [k for k in q if k.startswith('op') and k[2].isdigit()] and set(s) <= set(q)"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}).returncode == 0
