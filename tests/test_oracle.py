"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from suite import ORACLE, QUERIES
from suite.check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    verdict = compare(spark, con, sf_dir, name)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_few_queries_without_sql():
    assert set(QUERIES) - set(ORACLE) == {
        "similarity_join_ivf", "similarity_join_lsh", "heuristic_metadata",
    }
