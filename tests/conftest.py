import pytest

from matchloom.schema import SOURCE_COLUMNS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from matchloom.session import ship

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def records(spark):
    """Source records from tuples."""
    return lambda rows: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SOURCE_COLUMNS))


@pytest.fixture(scope="session")
def pairs(spark):
    """(query, target) rows."""
    return lambda rows: spark.createDataFrame(rows, "query string, target string")
