"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract
from plumbline.queries import files  # noqa: F401
from plumbline.queries.spark import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
