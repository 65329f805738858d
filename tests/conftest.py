import pytest

from millrace.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("local[4]", shuffle_partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
