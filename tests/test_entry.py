"""The entry module stands on its own where the training-text operators are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_groups' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=False)
    assert done.stdout.strip() == "fine", done.stderr


def test_with_them():
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q)
    if (REPO / "twinlake" / "llm").is_dir():
        assert sum(n.startswith("op") for n in q) == 10 and ("pipeline" in q) == (REPO / "corpus_pipeline.py").exists()


def test_nothing_else_imports_them():
    for f in (REPO / "twinlake").rglob("*.py"):
        if "llm" not in f.relative_to(REPO / "twinlake").parts:
            assert "twinlake.llm" not in f.read_text(), f
