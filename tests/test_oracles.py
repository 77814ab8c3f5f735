import pytest
from compare import compare

from loomgrain.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf, name):
    assert compare(spark, catalogue.queries()[name], SQL[name], sf) > 0


def test_all_queries_have_a_module():
    assert set(SQL) <= set(catalogue.queries())
