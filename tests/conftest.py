import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "newsloom-tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="newsloom-test-"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
