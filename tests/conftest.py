import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    session = local_session("quire-tests", "4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def rows(df, *columns):
    """Collected rows as sorted tuples."""
    got = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r))


pytest.rows = rows
