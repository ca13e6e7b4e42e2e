"""Every query with an oracle gives the oracle's rows; every other one gives rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import compare, oracle_connection  # noqa: E402

from taleloom.plans import ORACLES, QUERIES  # noqa: E402

from .conftest import SMALL  # noqa: E402

# Trained models take long and have tests of their own.
SLOW = {n for n in QUERIES if n not in ORACLES}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_same_rows(spark, con, name):
    assert compare(spark, con, name, SMALL) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
