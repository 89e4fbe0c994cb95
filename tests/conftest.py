import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillgraph.session import local_session

    session = local_session(4, "4g", 4, "tests")
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
