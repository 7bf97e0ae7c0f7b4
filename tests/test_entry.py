"""The driver's contract holds with and without the optional subpackage."""

import importlib
import sys


def test_without_the_optional_subpackage(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quillstore.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "quillstore.llm", None)
    try:
        importlib.reload(entry)
        names = set(entry.queries())
        assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
        assert set(entry.oracle_sql()) <= names
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_nothing_else_imports_it():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent
    for path in (root / "quillstore").rglob("*.py"):
        if "llm" not in path.relative_to(root / "quillstore").parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.MULTILINE), path
