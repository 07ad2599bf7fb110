import os
import sys

import pytest

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HOME, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
