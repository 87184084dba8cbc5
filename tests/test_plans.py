"""Every registered query runs on the smallest tables and agrees with its SQL."""

import pytest

import __spark_entry__ as contract
from textlens.plans import PLANS
from textlens.plans.check import difference, tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, con, name):
    got = PLANS[name].run(spark, SF_DIR).toPandas()
    assert len(got)
    if PLANS[name].sql:
        assert difference(got, con.execute(PLANS[name].sql).df()) is None


def test_contract(spark):
    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
