"""Every query of the core beside its SQL on the smallest data, and that all of them have a stable schema."""

from pathlib import Path

import pytest
from compare import compare, connect

from fathomry.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.ORACLES:
        assert compare(spark, con, FOLDER, name, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
    else:
        assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["visitor", "h24", "d7"]


def test_entry_says_what_it_gives():
    import __spark_entry__ as entry

    assert "verdict" not in entry.entry.__doc__ and "each visitor" in entry.entry.__doc__
