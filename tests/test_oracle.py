"""Every registered query against its SQL, over whole tables."""

import pytest

from checks.compare import compare, open_oracle
from checks.oracle import ORACLE
from checks.queries import REGISTERED

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF)


@pytest.mark.parametrize("name", list(REGISTERED))
def test_same_rows(spark, oracle, name):
    agrees, note = compare(spark, oracle, SF, name)
    assert agrees, note


def test_only_the_approximate_search_has_no_sql():
    assert set(REGISTERED) - set(ORACLE) == {"knn_lsh"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
