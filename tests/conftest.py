import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("groundweave-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def raster(spark):
    """Make a pixel table from 2-D arrays: raster(v=array, ...)."""

    def build(raster_id=0, **bands):
        first = next(iter(bands.values()))
        h, w = len(first), len(first[0])
        rows = [(raster_id, r, c, h, w, *[int(b[r][c]) for b in bands.values()]) for r in range(h) for c in range(w)]
        return spark.createDataFrame(rows, "raster_id INT, row INT, col INT, height INT, width INT, " + ", ".join(f"{n} INT" for n in bands))

    return build
