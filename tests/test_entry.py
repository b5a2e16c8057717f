"""The entry module works with and without the optional training-data operators."""
import importlib
import sys
from pathlib import Path

import pytest


@pytest.mark.parametrize("missing", ["corpus_pipeline", "docspark.llm"])
def test_entry_without_an_optional_part(monkeypatch, missing):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("docspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    if "docspark" in sys.modules:
        monkeypatch.delattr(sys.modules["docspark"], "llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "r9_hybrid_search" in names and "pipeline" not in names
    assert any(n.startswith("op") and n[2].isdigit() for n in names) == (missing == "corpus_pipeline" and (Path(entry.__file__).parent / "docspark/llm/queries.py").exists())
    assert set(entry.oracle_sql()) <= names
    monkeypatch.delitem(sys.modules, "__spark_entry__")
