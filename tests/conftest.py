from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larder.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LARDER_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture
def rows(spark):
    """A frame from a schema string and tuples."""
    def make(schema, *tuples):
        return spark.createDataFrame(list(tuples), schema)
    return make
