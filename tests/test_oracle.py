"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    if name not in entry.oracle_sql():
        # SQL cannot say these; their results are held against plain Python in the tests of their subpackage.
        assert entry.queries()[name](spark, SF).count() > 0
        return
    rows, problems = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert not problems


def test_entry(spark):
    assert entry.entry(spark).columns == ["p_brand", "cnt"]
