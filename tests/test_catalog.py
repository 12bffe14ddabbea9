import pytest

import __spark_entry__ as entry_point
from check import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns and df.limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, name):
    result, _ = compare(spark, con, SF, name, entry_point.queries()[name], entry_point.oracle_sql().get(name))
    assert result.startswith(("ok", "rows")), result
    assert "types" not in result, result
