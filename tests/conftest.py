import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a SQL expression over a column ``x`` for each given value."""

    def run(expression, values, kind="string"):
        rows = [(n, v) for n, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"n int, x {kind}").coalesce(1)
        return [r.y for r in df.selectExpr("n", f"{expression} as y").orderBy("n").collect()]

    return run
