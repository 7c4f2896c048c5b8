import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from faultframe.session import local_session

    session = local_session(partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted plain tuples of a small result."""
    return lambda df, *columns: sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
