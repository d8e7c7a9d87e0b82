import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import local

    session = local(8, 8, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
