import pytest

from partita.llm import registry

from ..oracle import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert same(spark, sf, registry.QUERIES[name], registry.SQL[name]) > 0
