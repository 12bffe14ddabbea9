import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Frames in which one entity holds a third of the rows; run and frame order them."""
    rows = []
    for i in range(900):
        entity = "big" if i % 3 == 0 else f"e{(i * 7) % 40:02d}"
        rows.append((entity, (i * 31) % 11, i, float((i * 13) % 101) / 7.0, 2.0, float(len(entity))))
    rows += [("single", 0, 0, 1.0, 2.0, 6.0), (None, 1, 1, 1.0, 2.0, 0.0)]
    return spark.createDataFrame(rows, "entity string, run int, frame int, a double, flat double, y double").cache()
