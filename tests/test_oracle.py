"""Every registered query beside its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from suite import compare

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(compare.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare.difference(spark, con, name, SF) is None


def test_every_query_has_sql():
    assert compare.QUERIES.keys() == compare.ORACLE.keys()
    assert compare.QUERIES.keys() <= contract.queries().keys()


def test_entry_runs(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables not here")
    rows = contract.entry(spark).collect()
    assert [r.perplexity for r in rows] == sorted((r.perplexity for r in rows), reverse=True) and rows
