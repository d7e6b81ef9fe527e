import pytest

from quire.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "6g", 4)


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
