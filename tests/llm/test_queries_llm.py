"""Queries of the corpus operators against their check SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import SF

from assayline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    ok, message = compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
    assert ok, message
