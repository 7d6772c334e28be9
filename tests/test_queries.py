"""Every query with SQL against DuckDB on the smallest tables."""

import pytest
from oracle import same

from quarry import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracles()[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
