import pytest

from partita.plans import queries, registry  # noqa: F401

from .oracle import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert same(spark, sf, registry.QUERIES[name], registry.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
