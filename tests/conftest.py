import pytest

from cohera.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
