import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfsight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "shelfsight-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """``rows(schema, *tuples)`` makes a DataFrame."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
