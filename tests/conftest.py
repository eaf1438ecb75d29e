import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from panelcast.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, app_name="panelcast-tests")
    yield s


def rows(df, *cols):
    """Collect ``cols`` sorted, as plain tuples."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
