import pytest

from plotline.plans import registry
from tests.oracle import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(registry.ORACLE_SQL[name], sf_dir)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
