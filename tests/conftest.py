import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check import spark_session

    s = spark_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture
def segments(spark):
    """Force the segmented path: no input counts as small."""
    spark.conf.set("spark.tallyloom.windowBytes", "0")
    yield
    spark.conf.unset("spark.tallyloom.windowBytes")
