import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from recallspark.session import local_session

    return local_session(8, "tests", "4g")


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    from recallspark.plans.compare import connect

    return connect(small)
