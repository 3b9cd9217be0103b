import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from querysieve.session import local_session

    return local_session(8, partitions=4)


@pytest.fixture(scope="session")
def sf():
    return DATA
