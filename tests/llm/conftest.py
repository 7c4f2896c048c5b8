import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs; the other columns do not matter."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    return lambda *rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kind)
