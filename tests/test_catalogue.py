import pytest

from corpuswell.plans import catalogue, phases
from tests.oracle import same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = {**catalogue.QUERIES, **phases.QUERIES}, {**catalogue.ORACLE, **phases.ORACLE}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert same(spark, SF, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
