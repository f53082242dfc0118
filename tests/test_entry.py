import importlib
import sys


def test_without_llm(monkeypatch):
    """The entry works where the training-data subpackage is gone."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "degree_stats" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    sys.modules.pop("__spark_entry__", None)


def test_names_match():
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
