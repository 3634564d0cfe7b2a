"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_queries_are_there_without_the_subpackage(tmp_path):
    for x in ("gritstone", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "gritstone/llm", ignore_errors=True)
    left = names(str(tmp_path))
    assert "patent_results" in left and not [n for n in left if n.startswith("op") or n == "pipeline"]
    assert set(left) <= set(names(ROOT))


def test_a_broken_module_of_the_subpackage_is_not_hidden(tmp_path):
    for x in ("gritstone", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
