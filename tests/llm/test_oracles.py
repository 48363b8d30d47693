import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare  # noqa: E402

from blockmill.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
