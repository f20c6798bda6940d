"""Every query that has SQL gives the same rows as DuckDB does."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from storyline.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, columns):
    order = sorted(columns)
    return sorted(repr(tuple(dict(zip(columns, r, strict=True))[c] for c in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(found.columns)
        assert plain(rows, got.columns) == plain(found.fetchall(), found.columns)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_training_data_package_may_be_absent(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).parent.parent
    shutil.copytree(root / "storyline", tmp_path / "storyline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1:] == ["False", "True"]
