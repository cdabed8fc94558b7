import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from clickloom.storage import release
    from tests.compare import session

    s = session("4")
    yield s
    release(s)


def rows(df, *order):
    """Collected rows as plain tuples, ordered when asked."""
    out = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return out
