import os

import pytest
from oracle import compare

from apilattice import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], registry.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
