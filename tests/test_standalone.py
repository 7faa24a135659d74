"""The library stands without the corpus operators and their pipeline."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"], list(e.queries())
assert "range_query" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.entry(spark).count())
"""


def _copy(tmp_path, *gone):
    to = tmp_path / "repo"
    shutil.copytree(HERE, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for x in gone:
        target = to / x
        shutil.rmtree(target, ignore_errors=True) if target.is_dir() else target.unlink(missing_ok=True)
    return to


def _run(repo):
    env = {**os.environ, "PYTHONPATH": str(repo)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=repo, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0


def test_without_operators(tmp_path):
    _run(_copy(tmp_path, "tessera/llm", "tests/llm"))


def test_without_operators_and_pipeline(tmp_path):
    _run(_copy(tmp_path, "tessera/llm", "tests/llm", "corpus_pipeline.py"))
