import os
import sys

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trendspark.session import local_session

    s = local_session("*", 8, app="trendspark-tests")
    yield s
