import importlib
import re
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


def test_works_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "tidemark.llm.catalogue", None)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    names = importlib.reload(entry).queries()
    assert "p3_found" in names and "p5_found" in names and "p1_found" not in names


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) tidemark\.llm", path.read_text(), re.M), path
