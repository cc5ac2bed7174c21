"""Every registered query beside its SQL twin on the smallest tables."""

import os

import pytest
from compare import compare, connect

from pagerisk.plans import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    status, _, note = compare(spark, con, SF, queries()[name], oracle_sql().get(name))
    assert status in ("ok", "rows"), note


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
