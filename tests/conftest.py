import pytest

from rankwright.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8, driver_memory="4g", **{"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
