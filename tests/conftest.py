import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from seekwell import local_session, ship_package

    session = local_session("8", "tests")
    ship_package(session)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_files(spark):
    """Snapshot rows from `{(folder, path): content}`."""
    from seekwell.schemas import FILES

    def make(contents):
        rows = [(f, p, c, len(c.encode())) for (f, p), c in contents.items()]
        return spark.createDataFrame(rows, FILES)

    return make
