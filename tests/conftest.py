import pytest

from lekhya.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
