import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from changeloom.session import local_session
    session = local_session(8, "8g", **{"spark.sql.shuffle.partitions": "4"})
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF
