import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpusgate.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *columns):
    """The rows as sorted tuples; nulls sort first."""
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


pytest.rows = rows
