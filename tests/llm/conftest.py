import pytest


@pytest.fixture
def nothing_broadcast(spark):
    """A broadcast of any rows fails, as that of a large table does for want of the driver's memory."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "16k")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")
