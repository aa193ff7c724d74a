import pytest

from plumbline.plans.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("plumbline-tests", "local[8]", {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def people(spark):
    """Rows of a small survey from (id, enumerator, cluster, district, age, income,
    status, hours) tuples."""
    columns = ("record_id string, enumerator_id string, cluster_id string, "
               "district_code string, age bigint, income double, employment_status string, "
               "working_hours bigint")

    def build(rows):
        return spark.createDataFrame(rows, columns).coalesce(2)
    return build
