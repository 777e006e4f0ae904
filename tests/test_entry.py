import importlib
import sys

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    got = entry.queries()["p3_found"](spark, SF)
    assert got.columns == ["book_hash", "field", "pos", "item"] and got.count() > 0
    assert entry.queries()["p1_found"](spark, SF).columns == ["record_id", "child", "node_path"]


def test_core_without_the_text_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("shelfwright.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "shelfwright.llm", None)
    fresh = importlib.reload(entry)
    assert "p1_found" in fresh.queries() and "p2_found" not in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)
