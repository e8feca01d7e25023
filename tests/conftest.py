import pytest

from folioscope.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]")
    session.sparkContext.setLogLevel("ERROR")
    return session
