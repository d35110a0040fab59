import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwork.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g"
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
