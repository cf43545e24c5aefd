"""The registry without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

from checks.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True)
    return [line.split() for line in ran.stdout.splitlines()[-2:]]


def test_queries_without_the_subpackage(tmp_path):
    """With and without the pipeline's file, once the subpackage's folders are gone."""
    folder = tmp_path / "copy"
    kept = shutil.ignore_patterns(".git", "__pycache__", "llm", "testdata")
    shutil.copytree(ROOT, folder, ignore=kept)
    for _ in range(2):
        found, with_sql = names(folder)
        assert found == sorted(QUERIES) == with_sql
        (folder / "corpus_pipeline.py").unlink(missing_ok=True)
