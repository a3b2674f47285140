"""The entry point, with and without the training-data subpackage."""

import importlib
import sys


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_without_training_data_operators(monkeypatch):
    import __spark_entry__ as e

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("corpusmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpusmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        bare = importlib.reload(e)
        assert not any(n.startswith("op") or n == "pipeline" for n in bare.queries()) and len(bare.queries()) > 90
    finally:
        monkeypatch.undo()
        importlib.reload(e)
