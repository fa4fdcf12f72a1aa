"""The driver contract, with and without the corpus package."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as driver

REPO = Path(__file__).resolve().parent.parent


def test_contract():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values()) and len(queries) > 120


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["pk", "cl", "hlc", "origin", "a", "b"] and rows.count() > 0


def test_works_without_the_corpus_package(tmp_path):
    shutil.copytree(REPO / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    count, corpus = said.stdout.split()
    assert int(count) > 120 and corpus == "False"
