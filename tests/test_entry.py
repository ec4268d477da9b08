"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("lastrum/llm", "tests/llm"), ("lastrum/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without_the_subpackage(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        shutil.rmtree(tree / name) if (tree / name).is_dir() else (tree / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and 'pipeline' not in q and set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tree, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tree)})
    assert done.returncode == 0, done.stderr[-800:]
