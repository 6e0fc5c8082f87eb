"""The named queries against their SQL at the smallest scale; `tools/check.py` does the same for any."""

import pytest

import __spark_entry__ as contract
from catalog.queries import QUERIES
from tools.check import compare, connect

@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 11 and "inferred_type" in df.columns


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, db, folder, name):
    verdict, _ = compare(spark, db, folder, name)
    assert verdict.startswith(("ok", "rows only")), verdict
