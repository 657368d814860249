import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))
DATA = "/root/testdata/sf0.001"


# Column builders are used while tests are collected, so the session starts here.
SPARK = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture(scope="session")
def one(spark):
    """Values of column builders over one row."""

    def run(row, schema, *cols):
        r = spark.createDataFrame([row], schema).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
        out = [plain(v) for v in r]
        return out[0] if len(out) == 1 else out

    return run


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v
