import os

import pytest

from notegraph.plans import notes, retrieval

from .compare import SF_DIR, assert_same, connect

QUERIES, SQL = retrieval.queries() | notes.queries(), retrieval.oracle_sql() | notes.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_without_the_optional_folder(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "llm_queries", None)
    monkeypatch.setattr(entry, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
