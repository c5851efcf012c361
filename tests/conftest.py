import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from glintflow.session import local_session

    return local_session(8, 4, "tests")


@pytest.fixture(scope="session")
def tiny():
    return TINY
