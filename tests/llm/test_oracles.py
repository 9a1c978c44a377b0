import pytest
from oracle import compare

from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLES[name])
