import pytest

from hanweave.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="4g", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def data():
    return DATA
