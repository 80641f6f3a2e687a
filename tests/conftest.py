import pytest

from siltstone.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
