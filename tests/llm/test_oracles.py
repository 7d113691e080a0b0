import pytest

from corpuswell.llm import queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE[name])
