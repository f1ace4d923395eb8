"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_flagship_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["flag", "n", "mean"] and frame.count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(REPO / name, tmp_path)
    shutil.copytree(REPO / "spindle", tmp_path / "spindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    queries, oracles = map(int, said.stdout.split())
    assert queries == oracles > 40
