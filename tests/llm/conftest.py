import pytest


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Small inputs in many small jobs: fewer tasks a job."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
