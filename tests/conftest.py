import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from fieldloom.session import importable_on_workers, local_session

    session = local_session(8, "tests")
    importable_on_workers(session)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
