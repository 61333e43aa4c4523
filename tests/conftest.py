import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Apply a Column function to a list of strings and collect the results in order."""
    from pyspark.sql import functions as F

    def run(fn, cells):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, s string")
        return [r["v"] for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]

    return run
