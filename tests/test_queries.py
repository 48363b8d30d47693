import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare  # noqa: E402

from blockmill.queries import ORACLES, QUERIES  # noqa: E402


def test_each_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
