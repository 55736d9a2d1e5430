import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
EVENT_LOG_DIR = tempfile.mkdtemp(prefix="tessera-eventlog-")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    from tessera.sources.eventlog import event_log_conf

    s = build_session("local[4]", "tessera-tests", shuffle_partitions=4,
                      extra=event_log_conf(EVENT_LOG_DIR))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tessera-test-")
