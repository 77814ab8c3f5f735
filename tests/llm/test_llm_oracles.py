import pytest
from compare import compare

from loomgrain.llm import entry

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf, name):
    assert compare(spark, entry.queries()[name], SQL[name], sf) > 0
