import logging
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textlab.session import local_session

    session = local_session(8, "textlab-tests")
    session.sparkContext.setLogLevel("ERROR")
    logging.getLogger("DataFrameQueryContextLogger").disabled = True
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
