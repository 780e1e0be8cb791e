import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sessionlens.session import local_session

    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def sliced(spark):
    """Force the sliced form of the ordered operators by a tiny group bound."""
    from sessionlens.session import GROUP_ROWS_KEY

    spark.conf.set(GROUP_ROWS_KEY, "20")
    yield
    spark.conf.unset(GROUP_ROWS_KEY)
