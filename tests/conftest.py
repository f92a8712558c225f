import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("anamnesis-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_groups(spark):
    """Make every group of more than three rows take the split route."""
    spark.conf.set("anamnesis.hotRows", "3")
    yield
    spark.conf.unset("anamnesis.hotRows")


@pytest.fixture
def split_subjects(spark):
    """Make the busier subjects of the given tables take the split route."""
    spark.conf.set("anamnesis.hotRows", "60")
    yield
    spark.conf.unset("anamnesis.hotRows")


@pytest.fixture(scope="session")
def duck():
    from oracle import SMALLEST, connect

    return connect(SMALLEST)
