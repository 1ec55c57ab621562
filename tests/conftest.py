import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TEST_SF_DIR = os.environ.get("SLOTWISE_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from slotwise.session import build_session

    session = build_session("local[*]", "slotwise-tests", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TEST_SF_DIR


@pytest.fixture(scope="session")
def fixture_jobs(spark, sf_dir):
    """Derived job history of the test folder, cached for the session."""
    from slotwise.sources.fixture import load_fixture

    fx = load_fixture(spark, sf_dir)
    jobs = fx.jobs.cache()
    jobs.count()
    yield fx.__class__(jobs=jobs, catalog=fx.catalog)
    jobs.unpersist()
