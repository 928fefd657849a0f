from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evistrata.session import local_session

    session = local_session(8, "evistrata-tests", 4)
    yield session
    session.stop()
