"""Every registered query outside the large-scale subpackage against its SQL on the smallest tables."""

import pytest

from tests.parity import connect, differences
from textaxis.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.schema == catalog.QUERIES[name](spark, SF).schema
    if name in catalog.ORACLES:
        assert differences(df, con, catalog.ORACLES[name]) == []
    else:
        assert df.count() > 0
