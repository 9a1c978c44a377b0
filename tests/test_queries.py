import pytest
from oracle import compare

from tessera.plans.file_queries import FILE_ORACLES, FILE_QUERIES
from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES

QUERIES, ORACLES = QUERIES | FILE_QUERIES, ORACLES | FILE_ORACLES
SF = "/root/testdata/sf0.001"


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "n"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
