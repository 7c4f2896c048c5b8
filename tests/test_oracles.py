"""Every registered query that has an oracle, on the smallest tables. The others are tested by their properties."""

import functools

import pytest

from faultframe.plans.registry import oracles, registered
from oracle_check import connect, differences

SF = "/root/testdata/sf0.001"


@functools.cache
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query(spark, name):
    frame = registered()[name](spark, SF).toPandas()
    assert differences(frame, connection().execute(oracles()[name]).df()) == []


def test_every_oracle_has_a_query():
    assert set(oracles()) <= set(registered())
