import os

import pytest

from notegraph.llm import queries

from ..compare import SF_DIR, assert_same, connect


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, connect(), queries.queries()[name], queries.oracle_sql()[name])
