import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=8, memory="6g", partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tidemark-test-")
