import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import check  # noqa: E402

from loopwright.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configure(check.local_session())
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
