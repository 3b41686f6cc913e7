import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

# Python workers import the package and the test modules by this path.
TESTS = Path(__file__).resolve().parent
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(TESTS.parent), str(TESTS), *filter(None, [os.environ.get("PYTHONPATH")])]
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("piisieve-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
