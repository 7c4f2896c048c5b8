"""The queries that SQL can express, on the smallest tables."""

import pytest
from oracle_check import connect, differences

from faultframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF).toPandas()
    # In pandas a column with NULLs is of doubles.
    numbers = {"op10_warc": "refers_to", "op12_prefix_trie": "parent_conv_id"}
    if name in numbers:
        frame = frame.astype({numbers[name]: "Int64"})
    assert differences(frame, connect(SF).execute(queries.ORACLES[name]).df()) == []
