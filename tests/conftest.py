import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortkit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="cohortkit-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortkit-test-ckpt-"))
    yield s
    s.stop()


def ts(text):
    import datetime as dt
    return dt.datetime.fromisoformat(text)
