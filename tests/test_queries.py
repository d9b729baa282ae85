"""Every registered query against its SQL, exactly, at the smallest scale."""

import pytest

from __spark_entry__ import load_queries
from compare import compare

QUERIES = load_queries()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, folder, name):
    verdict, rows, _, _, note = compare(spark, duck, QUERIES[name], folder)
    assert verdict in ("same", "rows-only"), note


def test_entry_needs_no_session_for_sql():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 200


def test_missing_package_leaves_the_rest(monkeypatch):
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("quireflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quireflow.llm", None)
    with pytest.warns(UserWarning):
        assert __spark_entry__.load_llm() == ({}, {})
    with pytest.warns(UserWarning):
        assert len(__spark_entry__.queries()) >= 200
