import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridloom.engine import get_session

    session = get_session("local[4]", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows(schema, tuples) -> DataFrame"""
    return lambda schema, data=(): spark.createDataFrame(list(data), schema)
