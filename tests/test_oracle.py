"""Every registered query of the library against its SQL on the smallest tables."""

import os

import pytest

from calltide.plans import registry
from tests.oracle import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert difference(spark, duck, registry.queries()[name], registry.oracle_sql()[name], SF) == ""
