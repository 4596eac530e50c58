import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from embertrail.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "embertrail-tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
        spark__default__parallelism="4", spark__checkpoint__dir=tempfile.mkdtemp(prefix="embertrail-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
