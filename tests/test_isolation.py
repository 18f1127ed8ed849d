"""The library, its queries and its tests work in a copy without the training-data folders."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
from lodestar.plans import catalogue
assert set(e.queries()) == set(catalogue.QUERIES), sorted(set(e.queries()) ^ set(catalogue.QUERIES))
assert set(e.oracle_sql()) == set(catalogue.ORACLE_SQL)
import lodestar.api, lodestar.session
"""


def _copy(to: str, *without: str) -> str:
    for name in ("lodestar", "tests"):
        shutil.copytree(os.path.join(HERE, name), os.path.join(to, name), ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and os.path.exists(os.path.join(HERE, name)):
            shutil.copy(os.path.join(HERE, name), to)
    for name in ("lodestar/llm", "tests/llm"):
        shutil.rmtree(os.path.join(to, name), ignore_errors=True)
    return to


def _run(folder: str, *argv: str) -> subprocess.CompletedProcess:
    env = {**os.environ, "PYTHONPATH": folder}
    return subprocess.run([sys.executable, *argv], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_queries_are_listed_with_the_pipeline_file_left_behind(tmp_path):
    done = _run(_copy(str(tmp_path)), "-c", PROBE)
    assert done.returncode == 0, done.stderr


def test_queries_are_listed_without_the_pipeline_file(tmp_path):
    done = _run(_copy(str(tmp_path), "corpus_pipeline.py"), "-c", PROBE)
    assert done.returncode == 0, done.stderr


def test_an_emptied_folder_counts_as_left_out(tmp_path):
    folder = _copy(str(tmp_path))
    os.makedirs(os.path.join(folder, "lodestar/llm/__pycache__"))
    done = _run(folder, "-c", PROBE)
    assert done.returncode == 0, done.stderr


def test_the_other_tests_are_collected(tmp_path):
    done = _run(_copy(str(tmp_path)), "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout + done.stderr
