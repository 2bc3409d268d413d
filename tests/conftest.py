import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from allocora.runtime import local_session

    session = local_session(cores=8, partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
