"""The entry module: its contract, and that it works without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and all(callable(q) for q in names.values())


@pytest.mark.parametrize("broken", [False, True])
def test_without_optional_parts(tmp_path, broken):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if broken:  # a fault inside the optional part is not hidden
        (tmp_path / "tidemark/llm").mkdir()
        (tmp_path / "tidemark/llm/__init__.py").write_text("")
        (tmp_path / "tidemark/llm/registry.py").write_text("import nowhere_to_be_found\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert (done.returncode != 0 and "nowhere_to_be_found" in done.stderr) if broken else done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            text = path.read_text()
            assert "tidemark.llm" not in text and ".llm" not in text and "corpus_pipeline" not in text, path
