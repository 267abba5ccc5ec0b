import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowmender.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def hot_from(monkeypatch):
    """Treat keys with few rows as hot, so that small tables take the salted path."""
    from rowmender.operators import skew

    def lower(rows: int, salts: int = 4) -> None:
        monkeypatch.setattr(skew, "MIN_HOT_ROWS", rows)
        monkeypatch.setattr(skew, "SALTS", salts)

    return lower
