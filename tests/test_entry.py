"""The entry points: imports with and without the optional parts, and the queries against DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLAIN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def comparable(frame):
    def value(x):
        if x is None or (not isinstance(x, list | tuple) and not hasattr(x, "shape") and x != x):
            return None
        return round(x, 9) if isinstance(x, float) else x

    columns = sorted(frame.columns)
    return sorted((tuple(map(value, row)) for row in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return found


@pytest.mark.parametrize("name", PLAIN)
def test_query_matches_sql(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert repr(comparable(got)) == repr(comparable(want))


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_optional_parts_can_be_taken_out(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'score_counts' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": ""})


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "callgrove").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path
