"""The entry with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder) -> list[set[str]]:
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, check=True).stdout
    return [set(line.split()) for line in out.splitlines()]


@pytest.mark.parametrize("pipeline", ["kept", "deleted"])
def test_queries_without_the_training_data_operators(tmp_path, pipeline):
    own = tmp_path / "repo"
    shutil.copytree(ROOT, own, ignore=shutil.ignore_patterns(".git", "llm", "*cache*", "spark-warehouse", *(["corpus_pipeline.py"] if pipeline == "deleted" else [])))
    names, with_sql = listed(own)
    assert len(names) > 60 and names == with_sql
    assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
