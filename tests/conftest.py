import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", 4).config("spark.ui.enabled", False)
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", False)
    return builder.getOrCreate()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples, lists as tuples."""

    def flat(x):
        return tuple(map(flat, x)) if isinstance(x, list) else x

    return lambda df: sorted((tuple(map(flat, r)) for r in df.collect()), key=repr)
