"""The library without its corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "tallyloom", tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_else_imports_them():
    for file in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "tallyloom.llm" not in file.read_text() and "from .llm" not in file.read_text() and "from ..llm" not in file.read_text()
