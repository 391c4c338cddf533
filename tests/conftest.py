import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "3")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "6g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lengths_table(spark):
    """Rows with skewed lengths: a third of them share one length."""
    import random

    rng = random.Random(4)
    rows = [(i, i, 7 if rng.random() < 0.34 else rng.choice([1, 2, 5, 10, 30, 64]))
            for i in range(1, 402)]
    return rows, spark.createDataFrame(rows, "record_id bigint, seq bigint, length int")
