"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from granary.plans.catalog import QUERIES
from tests.parity import DATA, compare, connect

SF = f"{DATA}/sf0.001"
# Long runs with their own tests or checked by the driver; here they would double the test time.
SLOW = {"pipeline_snapshot"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    problem, rows = compare(spark, con, QUERIES[name], SF)
    assert problem is None, problem
    # Without a twin at least something must come out; tests of the models say what.
    assert rows > 0 or QUERIES[name].sql is not None


def test_names_are_plain():
    assert all(name.replace("_", "").isalnum() for name in QUERIES)
    assert len(QUERIES) > 100
