import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from moltraj.session import local_session  # noqa: E402
from tests import fixtures  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "6g")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture(scope="session")
def landed(spark):
    return fixtures.landed(spark)


@pytest.fixture(scope="session")
def listed(spark):
    return spark.createDataFrame([(0, "12asA00")], "pos bigint, domain_id string")
