import pytest

from reelgrid.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column to a Python value."""

    def value(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    return value
