"""The library without the training-data subpackage, whose two folders may be deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert len(q) > 60 and set(s) <= set(q), (len(q), set(s) - set(q))
assert not [k for k in q if k.startswith("op") and k[2].isdigit()] and "pipeline" not in q
import bench
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_alone(tmp_path, pipeline):
    gone = ("llm", "__pycache__", ".git")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone))
    if not pipeline:
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "marginalia").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "marginalia.llm" not in path.read_text(), path
