import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from kbspark.session import importable, local_session

    s = local_session("tests", cpus="8", shuffle_partitions=8, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    importable(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
