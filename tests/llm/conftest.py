import pytest


@pytest.fixture(autouse=True, scope="package")
def few_partitions(spark):
    """The tables here are small: two shuffle partitions keep the many short jobs quick."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
