"""Every query against its SQL in DuckDB on the smallest tables."""

import sys

import pytest
from oracle import connection, same

from loamwork.plans import catalog as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, small, name):
    rows = Q.QUERIES[name](spark, small)
    same(rows, connection(small), Q.ORACLES[name])


def test_entry_without_the_subpackage(spark, monkeypatch):
    """With the subpackage hidden the entry has the other queries, and only those."""
    import __spark_entry__ as entry

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "loamwork.llm") or name.startswith("loamwork.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name.split(".queries")[0])

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("loamwork.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import loamwork

    monkeypatch.delattr(loamwork, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    assert set(entry.queries()) == set(Q.QUERIES) and set(entry.oracle_sql()) == set(Q.ORACLES)
    assert entry.entry(spark).count() > 0
