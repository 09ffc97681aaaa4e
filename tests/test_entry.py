import importlib
import sys


def test_a_subpackage_that_does_not_import_leaves_the_other_queries(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith(("loomtok.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "loomtok.llm.queries", None)
    importlib.reload(entry)
    names = entry.queries()
    assert len(names) > 50 and not any(k.startswith("op") or k == "pipeline" for k in names)
    assert set(entry.oracle_sql()) <= set(names)
