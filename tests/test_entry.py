import os
import shutil
import subprocess
import sys

from conftest import ROOT

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 84
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 60


def test_imports_without_the_optional_subpackage(tmp_path):
    for name in ("motifspark", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [k for k in q if k.startswith(('op1', 'op2', 'op3', 'op4', 'op5', 'op6', 'op7', 'op8', 'op9')) or k == 'pipeline'], q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_core_tests_without_the_optional_subpackage(tmp_path):
    """All core test modules are collected in a copy without it, and a few of them run."""
    for name in ("motifspark", "tests", "__spark_entry__.py", "bench.py"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", "-k", "kmer_index or two_queries_at_once"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and "2 passed" in done.stdout, done.stdout[-2000:]
