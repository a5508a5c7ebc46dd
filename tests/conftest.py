import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threatloom.session import local_session  # noqa: E402
from threatloom.streaming.state import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=3, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    for key, value in STATE_STORE.items():
        session.conf.set(key, value)
    yield session
    session.stop()
