import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cellweave.session import local_session, ship_package

    s = local_session()
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
