from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from scanloom.session import find_package, local_session

    session = local_session(cpus=8, shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    find_package(session)
    yield session
    session.stop()
