"""Every query of the panel catalogue against its SQL, or for rows where SQL can't say it."""

from __future__ import annotations

import pytest

from tests.oracle_check import SF, compare, duck
from tidemark.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
