"""The contract module loads without a session, and without the training-text package."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LOADS = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'op3_source_mixing' in q, 'pipeline' in q)"


def _run(folder) -> str:
    return subprocess.run([sys.executable, "-c", LOADS], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


def test_loads_without_a_session():
    n, *_ = _run(ROOT).split()
    assert int(n) > 150


def test_loads_without_the_llm_package(tmp_path):
    shutil.copytree(ROOT / "reelgrid", tmp_path / "reelgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, mixing, pipeline = _run(tmp_path).split()
    assert int(n) > 140 and mixing == pipeline == "False"
