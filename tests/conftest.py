import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from loomlake.session import get_session

    os.environ.setdefault("LOOMLAKE_DRIVER_MEMORY", "6g")
    session = get_session(4, spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
