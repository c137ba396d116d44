import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugeframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("local[8]")


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a set of tuples in column order."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
