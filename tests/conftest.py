from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from logsift.session import local_session

    return local_session(8, shuffle_partitions=8, app="tests")


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
