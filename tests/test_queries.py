import pytest

import __spark_entry__ as entry
from corpuscle.plans import registry
from tests.oracle import FOLDER, same

WITHOUT_SQL = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_gives_rows(spark, name):
    assert not registry.QUERIES[name](spark, FOLDER).isEmpty()


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]


def test_the_rest_stands_without_llm(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("corpuscle.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    import corpuscle

    monkeypatch.delattr(corpuscle, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "corpuscle.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(registry.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
