import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over literal named columns."""
    def run(expr, **cols):
        names = list(cols) or ["x"]
        df = spark.createDataFrame([tuple(cols.values()) or (1,)], ", ".join(f"{n} {_type(v)}" for n, v in (cols or {"x": 1}).items()))
        return df.select(expr().alias("v")).first()["v"]
    return run


def _type(v):
    return "array<string>" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "string"
