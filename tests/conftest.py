import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from sitelens.session import build_session
    ckpt = tempfile.mkdtemp(prefix="sitelens-test-ckpt-")
    s = build_session(master="local[4]", app="sitelens-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def make_pages(spark):
    """pages(url, status, html) from (url, status, html) tuples."""
    def make(rows):
        return spark.createDataFrame(rows, "url string, status int, html string")
    return make
