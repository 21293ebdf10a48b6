"""Every registered query against its expected SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from workload import compare
from workload.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    found = compare.difference(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert found is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1000
