import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from dredgeline.session import get_spark

    s = get_spark(os.environ.get("TEST_MASTER", "local[8]"), shuffle_partitions=4, spark__ui__showConsoleProgress="false")
    yield s
    s.stop()
