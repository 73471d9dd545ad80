import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import session

    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--master local[4] --driver-memory 4g pyspark-shell")
    s = session("tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="tests-"), spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
