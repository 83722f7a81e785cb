import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
# executors import the package from the same place
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from packetlens.session import build_session

    session = build_session("local[4]", 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF
