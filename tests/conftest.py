import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

TESTDATA = os.environ.get("PATRONAGE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from patronage.session import build_session

    session = build_session("patronage-tests", "local[*]", **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf{os.environ.get('PATRONAGE_TEST_SF', '0.01')}"


@pytest.fixture(scope="session")
def testdata():
    return TESTDATA
