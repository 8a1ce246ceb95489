import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from editlens.session import local_session

    session = local_session(8, "editlens-tests", "12g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
