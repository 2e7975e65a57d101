import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chronopanel.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
