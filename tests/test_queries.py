import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quarry import queries

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", queries.queries())
def test_matches_duckdb(spark, sf_dir, oracle, name):
    df = queries.queries()[name](spark, sf_dir)
    want = oracle.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [df.columns.index(c) for c in want.columns]
    assert sorted(str(tuple(r[i] for i in order)) for r in df.collect()) == sorted(map(str, want.fetchall()))


def test_entry_works_without_the_training_data_operators(tmp_path):
    (tmp_path / "quarry").mkdir()
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(path.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e, sys; assert set(e.oracle_sql()) <= set(e.queries()); assert 'q1_scan_agg' in e.queries(); assert not any(m.startswith('quarry.llm') for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "quarry").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
