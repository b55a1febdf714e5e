"""Every registered query against its check SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import SF

from __spark_entry__ import entry
from assayline.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, message = compare(spark, duck, SF, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_entry(spark):
    assert entry(spark).columns == ["lang", "n"]


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
