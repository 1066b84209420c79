import os

import pytest

from millrace.session import local_session, ship

DATA = os.environ.get("MILLRACE_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
