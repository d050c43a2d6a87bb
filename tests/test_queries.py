"""Every query of the library against its SQL twin at the smallest scale."""

import os

import pytest

from strataq import plans

from .oracle import assert_same, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(plans.QUERIES))
def test_query(spark, con, key):
    df = plans.QUERIES[key](spark, FOLDER)
    if key in plans.SQL:
        assert_same(df, con, plans.SQL[key])
    else:
        assert df.count() > 0


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.SQL) <= set(entry.oracle_sql())
