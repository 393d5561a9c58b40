import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splitlane.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8, "tests", spark__default__parallelism="2", spark__sql__shuffle__partitions="4"
    )
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(monkeypatch):
    """Make every lookup too big to broadcast."""
    from splitlane.operators import lookup

    monkeypatch.setattr(lookup, "BROADCAST_ROWS", -1)
