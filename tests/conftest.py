import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlark.session import build_session

    session = build_session("tests", master="local[8]", shuffle_partitions=8)
    yield session
    session.stop()
