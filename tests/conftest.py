import pytest

from textmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
