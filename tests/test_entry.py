"""The driver contract holds in a copy of the repository that lacks the llm folders, with and without the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; from lotwright.plans import catalogue as c; assert list(e.queries()) == list(c.QUERIES) and e.oracle_sql() == c.SQL and len(c.SQL) > 50"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_llm_folders(tmp_path, with_pipeline):
    copy = tmp_path / "repo"
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, copy, ignore=gone)
    assert not (copy / "lotwright/llm").exists() and (copy / "corpus_pipeline.py").exists() == (with_pipeline and (ROOT / "corpus_pipeline.py").exists())
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
