"""The optional subpackage is imported by nothing else, and the rest works without it."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "decisium").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*decisium\.llm", path.read_text(), re.M), path


def test_entry_without_the_subpackage(tmp_path):
    for name in ("decisium", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr
